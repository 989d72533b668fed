"""Source files that do not parse in their language."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.derivatives import MAX_TERMS, Grammar
from tarnwork.llm.grammars import LANGUAGES, Language
from tarnwork.llm.shell import Unclosed, shell_parts

STRING, JOINED, MAX_LINES = "\x01", "\x02", 500_000
#: Begin and end of a string with fields, and what stands for one whose fields are not closed.
FIELDS, CLOSED, BROKEN = "\x03", "\x04", "\x05"
SIGNS = str.maketrans(dict.fromkeys(STRING + JOINED + FIELDS + CLOSED + BROKEN, "?"))
VERDICT = "ok boolean, line bigint, reason string"


CLASSES = {"i": "I", "0": "N", STRING: "S", FIELDS: "FS", CLOSED: "FE"}
FIELD_STRING = re.compile(r"(?<![A-Za-z0-9_])(?P<kind>[fF][rR]?|[rR][fF])(?P<quote>\"\"\"|\'\'\'|\"|\')")
_SCAN = re.compile(rf"#[^\n]*|{FIELD_STRING.pattern}|{LANGUAGES['python'].strings}")
_INSIDE = re.compile(FIELD_STRING.pattern + "|" + LANGUAGES["python"].strings + r"|#[^\n]*|[()\[\]{}:!=\n]|[\"']")


def unfold_fields(text: str, lines_stay: bool) -> str:
    """Python text whose f-strings are replaced by their fields, each an expression in brackets between FIELDS and CLOSED.

    One that isn't closed, or has an open, empty or single closing brace, becomes BROKEN.
    """
    out, at = [], 0
    for m in iter(lambda: _SCAN.search(text, at), None):
        if not m["quote"]:
            out.append(text[at : m.end()])
            at = m.end()
            continue
        got, end = _fields(text, m.end(), m["quote"], "r" in m["kind"].lower(), lines_stay)
        out += [text[at : m.start()], got]
        at = end
    return "".join(out) + text[at:]


def _fields(text: str, at: int, quote: str, raw: bool, lines_stay: bool) -> tuple[str, int]:
    """What replaces an f-string whose content begins at `at`, and where it ends."""
    out, size = [FIELDS], len(text)
    while at < size:
        c = text[at]
        if text.startswith(quote, at):
            return "".join(out) + CLOSED, at + len(quote)
        if c == "\n":
            if len(quote) == 1:
                return BROKEN, at
            out.append(JOINED if lines_stay else "")
        elif c == "\\":
            if not raw and text.startswith("\\N{", at):
                at = max(text.find("}", at), at)
            else:
                at += 1
                if lines_stay and text[at : at + 1] == "\n":
                    out.append(JOINED)
        elif c in "{}":
            if text.startswith(c + c, at):
                at += 1
            elif c == "}":
                return BROKEN, at + 1
            else:
                got, at = _field(text, at + 1, quote, raw, lines_stay)
                out.append(got)
                if got == BROKEN:
                    return BROKEN, at
                continue
        at += 1
    return BROKEN, size


def _field(text: str, at: int, quote: str, raw: bool, lines_stay: bool) -> tuple[str, int]:
    """The expression of one field in brackets, then those of its format; `at` is behind the opening brace."""
    parts, depth = ["("], 0
    while m := _INSIDE.search(text, at):
        t = m[0]
        parts.append(text[at : m.start()])
        at = m.end()
        if m["quote"]:
            got, at = _fields(text, at, m["quote"], "r" in m["kind"].lower(), lines_stay)
            parts.append(got)
        elif t == "\n" and len(quote) == 1 and depth == 0 or t in ("'", '"'):
            break
        elif depth == 0 and (t in "}:" or (t == "!" and text[at : at + 1] != "=")):
            whole = "".join(parts)
            if whole[-1:] == "=" and whole[-2:-1] not in ("=", "!", "<", ">"):
                whole = whole[:-1]
            if not whole[1:].strip():
                return BROKEN, at
            whole += ")"
            if t == "!":
                kind = re.compile(r"\s*[rsa]\s*").match(text, at)
                if not kind or text[kind.end() : kind.end() + 1] not in ("}", ":"):
                    return BROKEN, at
                at = kind.end() + 1
                t = text[at - 1]
            while t == ":":
                stop = re.compile(r"[{}]|\n" if len(quote) == 1 else r"[{}]").search(text, at)
                if not stop or stop[0] == "\n":
                    return BROKEN, at
                whole += JOINED * text.count("\n", at, stop.start()) if lines_stay else ""
                at = stop.end()
                if stop[0] == "}":
                    break
                got, at = _field(text, at, quote, raw, lines_stay)
                if got == BROKEN:
                    return BROKEN, at
                whole += got
            return whole, at
        else:
            depth += (t in "([{" and len(t) == 1) - (t in ")]}" and len(t) == 1)
            if depth < 0:
                break
            parts.append(t)
    return BROKEN, min(at, len(text))


class Parser:
    """Judges texts of one language by derivatives over their lines.

    Strings, numbers and names of a whole text are first replaced by one sign each. Lines
    that then read alike lead from the same grammar term to the same next one, so the
    derivative by a whole line is also worked out once.
    """

    def __init__(self, language: Language):
        self.language = language
        self.grammar = Grammar(language.grammar)
        words = language.keywords.split()
        self.strip = re.compile(f"({language.strings})|(?:{language.comments})")
        self.strings = re.compile(language.strings)
        self.numbers = re.compile(rf"(?<![\w$]){language.numbers}") if language.numbers != "(?!)" else None
        keep = rf"(?!(?:{'|'.join(words)})(?![\w$]))" if words else ""
        self.names = re.compile(rf"(?<![\w$]){keep}{language.names}")
        self.tokens = re.compile(rf"{STRING}|{language.operators}|[A-Za-z_$][\w$]*|\S")
        self.known: dict = {}
        self.words = set(words)

    def plain(self, text: str, lines_stay: bool = False) -> str:
        """The text with S, N and I signs in place of strings, numbers and names, without comments."""
        lang = self.language
        text = text.translate(SIGNS).replace("\r\n", "\n")
        if lang is LANGUAGES["python"] and FIELD_STRING.search(text):
            text = unfold_fields(text, lines_stay)
        end = JOINED if lang.lines == "blocks" else "\n"
        for pattern, new in lang.before:
            text = pattern.sub(new if not lines_stay else lambda m, new=new: m.expand(new) + end * (m[0].count("\n") - m.expand(new).count("\n")), text)
        if lines_stay:
            text = self.strip.sub(lambda m: m[1] or " " + "\n" * m[0].count("\n"), text)
            text = self.strings.sub(lambda m: STRING + end * m[0].count("\n"), text)
        else:
            text = self.strip.sub(r"\1 " if lang.lines != "blocks" else r"\1", text)
            text = self.strings.sub(STRING, text)
        if lang is LANGUAGES["sql"]:
            text = text.lower()
        if self.numbers:
            text = self.numbers.sub("0", text)
        return self.names.sub("i", text)

    def split(self, line: str) -> list[str]:
        return [CLASSES.get(t, t) for t in self.tokens.findall(line)]

    def step(self, state: int, line: str) -> int:
        """The term after a line; the empty one if the line cannot stand here."""
        key = (state, line)
        after = self.known.get(key)
        if after is None:
            after = state
            for t in self.split(line):
                after = self.grammar.derive(after, t)
                if after == self.grammar.empty:
                    break
            self.known[key] = after
        return after

    def judge(self, text: str) -> tuple[bool, int | None, str | None]:
        """(valid, line of the failing token, why); truncated texts have no failing token."""
        if len(self.grammar.terms) > MAX_TERMS or len(self.known) > MAX_LINES:
            self.grammar.reset()
            self.known.clear()
        if self.language.lines == "yaml":
            return self.yaml(text)
        if self.language is LANGUAGES["bash"]:
            return self.shell(text.replace("\r\n", "\n"))
        if text.startswith("﻿"):
            text = text[1:]
        at = self.lines(self.plain(text))
        if at is None:
            return True, None, None
        if at < 0:
            return False, None, "truncated"
        where = self.lines(self.plain(text, lines_stay=True))
        return False, (at if where is None or where < 0 else where) + 1, "token"

    def lines(self, plain: str) -> int | None:
        """None if the text is valid, -1 if it ends too early, else the number of the failing line."""
        if self.language.lines == "blocks":
            return self.blocks(plain)
        g, step = self.grammar, self.step
        state, empty = g.start, g.empty
        mode, goes_on, ender = self.language.lines, self.language.goes_on, self.language.ender
        last = ""
        for n, row in enumerate(plain.split("\n")):
            row = row.strip()
            if not row:
                continue
            if mode == "ends" and last:
                if ender:
                    end = last[-1] in ")]}0" + STRING or last[-1] == "i" or last.endswith(("++", "--")) or re.search(r"(?:^|\W)(?:break|continue|return|fallthrough)$", last) is not None
                else:
                    end = row[0] not in goes_on or row[:2] in ("++", "--", "/i")
                if end:
                    after = g.derive(state, "NL")
                    if after != empty:
                        state = after
            elif mode == "all" and last:
                state = g.derive(state, "NL")
                if state == empty:
                    return n - 1
            state = step(state, row)
            if state == empty:
                return n
            last = row
        if mode == "ends" or mode == "all":
            after = g.derive(state, "NL")
            if after != empty:
                state = g.alt(state, after)
        return None if g.nullable(state) else -1

    def blocks(self, plain: str) -> int | None:
        """As lines, for a language whose blocks are given by indentation."""
        g, step = self.grammar, self.step
        state, empty = g.start, g.empty
        stack = [(0, 0)]
        depth = 0
        joined = 0
        for n, row in enumerate(plain.split("\n")):
            n += joined
            if JOINED in row:
                joined += row.count(JOINED)
                row = row.replace(JOINED, "")
            line = row.strip()
            if not line:
                continue
            if depth == 0:
                if row[0] in " \t\f":
                    lead = row[: len(row) - len(row.lstrip())].replace("\f", "")
                    here = (len(lead.expandtabs(8)), len(lead.expandtabs(1))) if "\t" in lead else (len(lead), len(lead))
                else:
                    here = (0, 0)
                if here != stack[-1]:
                    if here[0] > stack[-1][0]:
                        if here[1] <= stack[-1][1]:
                            return n
                        stack.append(here)
                        state = g.derive(state, "IN")
                    else:
                        while stack[-1][0] > here[0]:
                            stack.pop()
                            state = g.derive(state, "OUT")
                        if stack[-1] != here:
                            return n
                    if state == empty:
                        return n
            state = step(state, line)
            if state == empty:
                return n
            if "(" in line or "[" in line or "{" in line or depth:
                depth += line.count("(") + line.count("[") + line.count("{") - line.count(")") - line.count("]") - line.count("}")
            if depth == 0:
                state = g.derive(state, "NL")
                if state == empty:
                    return n
        for _ in stack[1:]:
            state = g.derive(state, "OUT")
        return None if depth == 0 and g.nullable(state) else -1

    def shell(self, text: str) -> tuple[bool, int | None, str | None]:
        """A script and each command nested in it by the same grammar."""
        try:
            *nested, script = shell_parts(text.removeprefix("\ufeff"), self.words)
        except Unclosed:
            return False, None, "truncated"
        bad = []
        for rows in (*nested, script):
            at = self.lines("\n".join(row for _, row in rows))
            if at is not None:
                bad.append(rows[at][0] if at >= 0 or rows is not script else None)
        if not bad:
            return True, None, None
        lines = [n for n in bad if n is not None]
        return (False, min(lines), "token") if lines else (False, None, "truncated")

    def yaml(self, text: str) -> tuple[bool, int | None, str | None]:
        g = self.grammar
        state = g.start
        line = 1
        for line, token in yaml_tokens(text):
            state = g.derive(state, token)
            if state == g.empty:
                return False, line, "token"
        return (True, None, None) if g.nullable(state) else (False, None, "truncated")


_KEY = re.compile(r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=\S))(?:[^:#\n]|:(?=\S)|(?<=\S)#)*?|<<)[ \t]*:(?=[ \t]|$)")
_FLOW = re.compile(r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*'|[\[\]{},]|:(?=[\s,\[\]{}]|$)|(?:[^\s,\[\]{}:#\"'\n]|:(?=[^\s,\[\]{}])|(?<=[^\s])[#\"'])(?:[^,\[\]{}:#\n]|:(?=[^\s,\[\]{}])|(?<=\S)#)*|#[^\n]*|\n|\S")


def yaml_tokens(text: str) -> Iterator[tuple[int, str]]:
    """(line, token) of block structure: KEY, DASH, VALUE, IN, OUT, DOC, flow brackets, BAD."""
    rows = text.replace("\r\n", "\n").lstrip("﻿").split("\n")
    whole = "\n".join(rows)  # flow collections are read from here, each once and over any number of lines
    begins = list(accumulate((len(row) + 1 for row in rows[:-1]), initial=0))
    stack: list[int] = []
    plain_at: int | None = None  # column beyond which a line continues the last plain value
    n = 0
    while n < len(rows):
        row = rows[n]
        n += 1
        body = row.strip()
        if not body:
            if "\t" in row and plain_at != -1:
                yield n, "BAD"
                return
            continue
        if body[0] == "#":
            plain_at = None
            continue
        if row.startswith(("---", "...")) and (len(row) == 3 or row[3] in " \t"):
            for _ in stack[1:]:
                yield n, "OUT"
            stack, plain_at = [], None
            yield n, "DOC"
            row = "   " + row[3:]
            body = row.strip()
            if not body or body[0] == "#":
                continue
        if row[0] == "%" and not stack:
            continue
        col = len(row) - len(row.lstrip(" "))
        key = _KEY.match(body)
        if row[col] == "\t" and (plain_at is None or key or (col <= plain_at and plain_at >= 0)):
            yield n, "BAD"
            return
        if plain_at is not None and col > plain_at and not key:
            if re.search(r":(?:\s|$)", body) and body[0] not in "\"'":
                yield n, "BAD"
            continue
        plain_at = None
        rest, at, first = row[col:], col, True
        while True:
            dash = rest == "-" or rest.startswith(("- ", "-\t"))
            if not stack:
                stack.append(at)
            elif at > stack[-1]:
                stack.append(at)
                yield n, "IN"
            elif first and at < stack[-1]:
                while len(stack) > 1 and stack[-1] > at:
                    stack.pop()
                    yield n, "OUT"
                if stack[-1] != at:
                    yield n, "BAD"
                    return
            first = False
            if not dash:
                break
            yield n, "DASH"
            tail = rest[1:].lstrip(" \t")
            at += len(rest) - len(tail)
            rest = tail
            if not rest or rest[0] == "#":
                rest = ""
                break
            if not (_KEY.match(rest) or rest == "-" or rest.startswith("- ")):
                break
        if not rest:
            continue
        base = stack[-1]
        key = _KEY.match(rest)
        if key:
            yield n, "KEY"
            rest = rest[key.end() :].strip()
        elif not dash and at != col:
            base = stack[-1]
        rest = re.sub(r"^(?:[&!][^\s,\[\]{}]*[ \t]*)+", "", rest)
        if not rest or rest[0] == "#":
            continue
        if rest[0] in "|>" and re.fullmatch(r"[|>][-+0-9]{0,2}[ \t]*(?:#.*)?", rest):
            yield n, "VALUE"
            inner = None
            while n < len(rows) and (not rows[n].strip() or len(rows[n]) - len(rows[n].lstrip(" ")) > base):
                lead = len(rows[n]) - len(rows[n].lstrip(" "))
                if rows[n].strip() and rest[-1] not in "0123456789":
                    inner = lead if inner is None else inner
                    if lead < inner:
                        yield n + 1, "BAD"
                        return
                n += 1
            continue
        if rest[0] in "[{\"'":
            start, depth, end = n, 0, None
            row_end = row if row.endswith(rest) else row.rstrip()
            for m in _FLOW.finditer(whole, begins[n - 1] + len(row_end) - len(rest)):
                t = m[0]
                if t == "\n" or (t[0] == "#" and whole[m.start() - 1] in " \t\n"):
                    continue
                if len(t) == 1 and t in "\"'":
                    yield start, "BAD"
                    return
                yield start, t if t in "[]{},:" else "VALUE"
                depth += (t in "[{") - (t in "]}")
                if depth <= 0:
                    end = m.end()
                    break
            if end is None:
                yield len(rows), "BAD"
                return
            n = bisect_right(begins, end - 1)
            tail = whole[end : begins[n - 1] + len(rows[n - 1])]
            if tail.strip() and not re.match(r"[ \t]+#", tail):
                yield n, "BAD"
                return
            continue
        rest = re.sub(r"[ \t]#.*$", "", rest).rstrip()
        if rest[0] in "%@`" or re.search(r":(?:\s|$)", rest) or rest[0] in ",]}" or re.match(r"[-?:](?:\s|$)", rest) or (rest[0] in "|>" and key):
            yield n, "BAD"
            return
        yield n, "VALUE"
        plain_at = base if key or dash else -1
    for _ in stack[1:]:
        yield n, "OUT"


@lru_cache(maxsize=None)
def parser(language: str) -> Parser:
    return Parser(LANGUAGES[language])


def check_syntax(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """project_id, path, language, ok, line, reason of every file that can be judged.

    `files` needs project_id, path, language, content_hash, chunk_count; `chunks` needs
    project_id, path, file_hash, chunk_id, start_line, text; paths are canonical. Judged are
    files of a language with a grammar whose distinct pieces with file_hash = content_hash
    number exactly chunk_count; the text is those pieces by start_line. `line` is the line of
    the failing token, null where the text ends too early (`truncated`).

    Pieces are shuffled once, by file, and stream through the parser in order; a task holds one
    file's text at a time, and copies of a piece are passed over as they come. Repeated pieces and rows of files count once; null texts count as
    empty, rows with a null key or language are not judged.
    """
    key = ["project_id", "path"]
    wanted = (
        files.select(*key, F.lower("language").alias("language"), "content_hash", "chunk_count")
        .where(F.col("language").isin(list(LANGUAGES)) & (F.col("chunk_count") > 0))
        .groupBy(*key, "content_hash").agg(F.min("language").alias("language"), F.max("chunk_count").alias("chunk_count"))
    )
    pieces = chunks.select(*key, F.col("file_hash").alias("content_hash"), "chunk_id", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = pieces.repartition(*key, "content_hash")  # the only shuffle of texts: the join and the order of pieces keep to it
    met = pieces.join(wanted, [*key, "content_hash"]).sortWithinPartitions(*key, "content_hash", "start_line", "chunk_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, texts, ids, head = None, [], set(), None

        def verdict() -> list[tuple]:
            if name is None or len(ids) != head[1]:
                return []
            return [(name[0], name[1], head[0], *parser(head[0]).judge("".join(texts)))]

        columns = ["project_id", "path", "language", "ok", "line", "reason"]
        for pdf in batches:
            out = []
            for p, f, h, cid, text, lang, count in zip(pdf["project_id"], pdf["path"], pdf["content_hash"], pdf["chunk_id"], pdf["text"], pdf["language"], pdf["chunk_count"]):
                if (p, f, h) != name:
                    out += verdict()
                    name, texts, ids, head = (p, f, h), [], set(), (lang, count)
                if cid not in ids:
                    ids.add(cid)
                    texts.append(text)
            yield pd.DataFrame(out, columns=columns).astype({"line": "Int64"})
        yield pd.DataFrame(verdict(), columns=columns).astype({"line": "Int64"})

    return met.select(*key, "content_hash", "chunk_id", "text", "language", "chunk_count").mapInPandas(run, f"project_id string, path string, language string, {VERDICT}")


def failure_rates(verdicts: DataFrame) -> DataFrame:
    """Judged and failing files and their rate per project and language."""
    return verdicts.groupBy("project_id", "language").agg(F.count("*").alias("judged"), F.count_if(~F.col("ok")).alias("failing")).withColumn("rate", F.col("failing") / F.col("judged"))
