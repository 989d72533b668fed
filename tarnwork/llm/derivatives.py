"""Memoised parsing with derivatives: recognising token streams by the derivative of a grammar.

A grammar is written as rules, `name = a 'b' (c | d)* e? ;`. A quoted word is a token, a bare
upper-case word a token class, any other word a rule. Rules must not be left-recursive. Every
distinct grammar term exists once; its derivative by a token and its nullability are worked
out once and kept, so a stream over familiar shapes is a walk through known terms.
"""

from __future__ import annotations

import re

EMPTY, EPS, TOKEN, SEQ, ALT, STAR, RULE = range(7)
MAX_TERMS = 400_000


class Grammar:
    def __init__(self, text: str, start: str = "file"):
        self.rules: dict[str, int] = {}
        self.text = text
        self.start_rule = start
        self.reset()

    def reset(self) -> None:
        """Forgets all terms; bounds the memory of a worker that sees very many shapes."""
        self.terms: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.rules = {}
        self.empty, self.eps = self.term((EMPTY,)), self.term((EPS,))
        for name, body in re.findall(r"(?:^|\n)[ \t]*(\w+)[ \t]*=((?:[^;']|'[^']+')*);", self.text):
            toks = re.findall(r"'[^']+'|\w+|[()|*+?]", body)
            node, at = self.alternatives(toks, 0)
            if at != len(toks):
                raise ValueError(f"rule {name}: {toks[at:]}")
            self.rules[name] = node
        self.can_end = dict.fromkeys(self.rules, False)
        self.ends: dict[int, bool] = {}
        changed = True
        while changed:
            self.ends.clear()
            now = {r: self.nullable(n) for r, n in self.rules.items()}
            changed, self.can_end = now != self.can_end, now
        self.ends.clear()
        self.start = self.term((RULE, self.start_rule))

    def term(self, t: tuple) -> int:
        i = self.ids.get(t)
        if i is None:
            i = self.ids[t] = len(self.terms)
            self.terms.append(t)
        return i

    def alternatives(self, toks: list[str], at: int) -> tuple[int, int]:
        node, at = self.sequence(toks, at)
        while at < len(toks) and toks[at] == "|":
            more, at = self.sequence(toks, at + 1)
            node = self.alt(node, more)
        return node, at

    def sequence(self, toks: list[str], at: int) -> tuple[int, int]:
        parts = []
        while at < len(toks) and toks[at] not in "|)":
            t = toks[at]
            if t == "(":
                node, at = self.alternatives(toks, at + 1)
            elif t[0] == "'":
                node = self.term((TOKEN, t[1:-1]))
            elif t.isupper():
                node = self.term((TOKEN, t))
            else:
                node = self.term((RULE, t))
            at += 1
            while at < len(toks) and toks[at] in "*+?":
                more = self.term((STAR, node))
                node = more if toks[at] == "*" else self.alt(node, self.eps) if toks[at] == "?" else self.seq(node, more)
                at += 1
            parts.append(node)
        node = self.eps
        for p in reversed(parts):
            node = self.seq(p, node)
        return node, at

    def seq(self, a: int, b: int) -> int:
        if a == self.empty or b == self.empty:
            return self.empty
        if a == self.eps:
            return b
        if b == self.eps:
            return a
        heads = []
        while self.terms[a][0] == SEQ:
            _, head, a = self.terms[a]
            heads.append(head)
        node = self.term((SEQ, a, b))
        for head in reversed(heads):
            node = self.term((SEQ, head, node))
        return node

    def alt(self, *nodes: int) -> int:
        """Any of the terms. Those that begin alike are joined behind their common beginning,

        so that brackets in which two readings go on side by side deepen a term on its right
        only, and a step inside them costs the same at every depth.
        """
        flat = set()
        for n in nodes:
            t = self.terms[n]
            flat.update(t[1] if t[0] == ALT else (n,))
        flat.discard(self.empty)
        if len(flat) > 1:
            tails: dict[int, list[int]] = {}
            for n in flat:
                t = self.terms[n]
                head, tail = (t[1], t[2]) if t[0] == SEQ else (n, self.eps)
                tails.setdefault(head, []).append(tail)
            if len(tails) < len(flat):
                flat = {self.seq(head, rest[0] if len(rest) == 1 else self.alt(*rest)) for head, rest in tails.items()}
        if not flat:
            return self.empty
        return flat.pop() if len(flat) == 1 else self.term((ALT, frozenset(flat)))

    def nullable(self, i: int) -> bool:
        ends, waiting = self.ends, [i]
        while waiting:
            n = waiting[-1]
            if n in ends:
                waiting.pop()
                continue
            t = self.terms[n]
            kind = t[0]
            if kind in (SEQ, ALT):
                parts = t[1:] if kind == SEQ else t[1]
                known = [ends.get(x) for x in parts]
                decided = (False in known) if kind == SEQ else (True in known)
                if not decided and None in known:
                    waiting.extend(x for x, k in zip(parts, known) if k is None)
                    continue
                ends[n] = decided if kind == ALT else not decided
            else:
                ends[n] = kind in (EPS, STAR) or (kind == RULE and self.can_end[t[1]])
            waiting.pop()
        return ends[i]

    def derive(self, i: int, token: str) -> int:
        """What may follow after the token; the empty term if it cannot stand here.

        Terms whose derivative waits for that of their parts lie on a list, so nesting of any
        depth needs no deeper calls.
        """
        steps = self.steps
        known = steps.get((i, token))
        if known is not None:
            return known
        waiting = [i]
        while waiting:
            n = waiting[-1]
            if (n, token) in steps:
                waiting.pop()
                continue
            t = self.terms[n]
            kind = t[0]
            if kind == SEQ:
                parts = t[1:] if self.nullable(t[1]) else t[1:2]
            elif kind == ALT:
                parts = tuple(t[1])
            else:
                parts = (t[1],) if kind == STAR else (self.rules[t[1]],) if kind == RULE else ()
            late = [x for x in parts if (x, token) not in steps]
            if late:
                waiting.extend(late)
                continue
            after = [steps[x, token] for x in parts]
            if kind == TOKEN:
                done = self.eps if t[1] == token else self.empty
            elif kind == SEQ:
                done = self.seq(after[0], t[2])
                if len(after) > 1:
                    done = self.alt(done, after[1])
            elif kind == ALT:
                done = self.alt(*after)
            elif kind == STAR:
                done = self.seq(after[0], n)
            else:
                done = after[0] if kind == RULE else self.empty
            steps[n, token] = done
            waiting.pop()
        return steps[i, token]
