"""Words of shell scripts: quotes, expansions and the commands nested in them, as bash reads them."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right

PLAIN = re.compile(r"[^\s\\'\"`$;&|()<>#]+")
OPERATOR = re.compile(r";;&|;;|;&|&&|\|\||\|&|<<<|<<-|<<|&>|>>|>&|<&|[;&|()<>]")
DELIMITER = re.compile(r"[ \t]*((?:\\.|'[^'\n]*'|\"[^\"\n]*\"|[^\s;&|()<>'\"\\])+)")
ANSI, TICKED = re.compile(r"(?:[^'\\]|\\[\s\S])*'"), re.compile(r"((?:[^`\\]|\\[\s\S])*)`")
IN_QUOTES, IN_BRACES, IN_SUMS = re.compile(r"[\"\\`$]"), re.compile(r"[}\"'\\`$]"), re.compile(r"[()\"'\\`$]")
#: Words after which a command may begin.
LEADS = {"then", "do", "else", "elif", "if", "while", "until", "!", "{", "time"}
#: Stands in a word for what is quoted or expanded, so that the word is no keyword.
OPAQUE = "\0"


class Unclosed(Exception):
    """A quote, an expansion or a here-document that is open at the end of the text."""


class Shell:
    """Parts of a text: (line, plain row) lists, the whole script last and before it the commands nested in it."""

    def __init__(self, text: str, words: set[str], line: int = 1):
        self.text, self.words, self.line = text, words, line
        self.parts: list[list[tuple[int, str]]] = []
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def line_of(self, at: int) -> int:
        return self.line + bisect_right(self.breaks, at - 1)

    def command(self, i: int, closer: str) -> int:
        """Reads commands from i to the closing sign or, without one, to the end; returns where it went on."""
        text, end = self.text, len(self.text)
        rows: list[tuple[int, str]] = []
        row: list[str] = []
        word: str | None = None
        first, test, regex = True, False, False  # a command may begin; within [[ ]]; after =~
        opened, cases, arrays = 0, [], []
        waiting: list[tuple[str, bool]] = []
        row_at = i

        def flush() -> None:
            nonlocal word, first, test, regex
            if word is None:
                return
            if test:
                regex = word == "=~"
                if word == "]]":
                    test = False
                row.append("]]" if word == "]]" else "i")
                first = False
            elif first and word == "[[":
                test = True
                row.append("[[")
            else:
                if first and word == "case":
                    cases.append(opened)
                elif first and word == "esac" and cases:
                    cases.pop()
                row.append(word if word in self.words or word in ("{", "}") else "i")
                first = not arrays and ((first and word in LEADS) or word in ("then", "do", "else") or (word == "in" and bool(cases)))
            word = None

        while i < end:
            c = text[i]
            if m := PLAIN.match(text, i):
                word, i = (word or "") + m[0], m.end()
            elif c == "\n":
                flush()
                i = self.bodies(i + 1, waiting)
                rows.append((self.line_of(row_at), " ".join(row)))
                row.clear()
                row_at, first = i, not arrays
            elif c.isspace():
                flush()
                i += 1
            elif c == "\\":
                if text[i + 1 : i + 2] != "\n":
                    word = (word or "") + OPAQUE
                i += 2
            elif c == "#":
                if word is None and not regex:
                    i = text.find("\n", i)
                    i = end if i < 0 else i
                else:
                    word, i = (word or "") + c, i + 1
            elif c in "'\"`$":
                word, i = (word or "") + OPAQUE, self.expansion(i)
            elif c in "<>" and text[i + 1 : i + 2] == "(":
                word, i = (word or "") + OPAQUE, self.command(i + 2, ")")
            elif c in "(|" and test and (regex or (c == "(" and word is not None)):
                word, i = (word or "") + OPAQUE, self.group(i + 1) if c == "(" else i + 1
            elif c == "(" and word is None and not test and text.startswith("((", i) and (first or row[-1:] == ["for"]) and (after := self.sum(i + 2)):
                row.append("i")
                i, first = after, False
            elif c == "(" and word is not None and word.endswith("="):
                flush()
                row.append("=(")
                opened += 1
                arrays.append(opened)
                i, first = i + 1, False
            else:
                if c in "<>" and word is not None and word.isdigit():
                    word = OPAQUE
                flush()
                op = OPERATOR.match(text, i)[0]
                if op == ")" and not opened and not cases and closer == ")":
                    self.close(rows, row, row_at)
                    return i + 1
                i += len(op)
                first = op not in ("<", ">", ">>", "<<<", ">&", "<&", "&>") and not arrays
                if op in ("<<", "<<-") and (m := DELIMITER.match(text, i)):
                    waiting.append((re.sub(r"\\(.)|['\"]", r"\1", m[1]), op == "<<-"))
                    row += ["<", "i"]
                    i, first = m.end(), False
                    continue
                row.append(op)
                if op == "(":
                    opened += 1
                elif op == ")" and not (cases and opened == cases[-1]):
                    if arrays and arrays[-1] == opened:
                        arrays.pop()
                        first = False
                    opened -= 1
        flush()
        if closer or waiting:
            raise Unclosed
        self.close(rows, row, row_at)
        return end

    def close(self, rows: list, row: list, row_at: int) -> None:
        rows.append((self.line_of(row_at), " ".join(row)))
        self.parts.append(rows)

    def bodies(self, i: int, waiting: list[tuple[str, bool]]) -> int:
        """Past the here-documents that begin on the line before."""
        for word, tabs in waiting:
            while True:
                if i >= len(self.text):
                    raise Unclosed
                stop = self.text.find("\n", i)
                stop = len(self.text) if stop < 0 else stop
                line = self.text[i:stop]
                i = stop + 1
                if (line.lstrip("\t") if tabs else line) == word:
                    break
        waiting.clear()
        return i

    def expansion(self, i: int, quoted: bool = False) -> int:
        """Past the quoted string or the expansion that begins at i."""
        text = self.text
        c, after = text[i], text[i + 1 : i + 2]
        if c == '"':
            return self.until('"', i + 1, IN_QUOTES, True)
        if c == "'":
            return self.past(None, i + 1)
        if c == "`":
            m = TICKED.match(text, i + 1)
            if not m:
                raise Unclosed
            inner = Shell(re.sub(r"\\([`\\$\"])" if quoted else r"\\([`\\$])", r"\1", m[1]), self.words, self.line_of(i))
            inner.command(0, "")
            self.parts += inner.parts
            return m.end()
        if after and after in "'\"" and not quoted:
            return self.past(ANSI, i + 2) if after == "'" else self.expansion(i + 1)
        if after == "{":
            return self.until("}", i + 2, IN_BRACES, quoted)
        if after == "(":
            return (text.startswith("$((", i) and self.sum(i + 3)) or self.command(i + 2, ")")
        return i + 1

    def past(self, pattern: re.Pattern | None, i: int) -> int:
        """Past a string in single quotes whose content begins at i."""
        m = pattern.match(self.text, i) if pattern else None
        at = m.end() if m else 0 if pattern else self.text.find("'", i) + 1
        if not at:
            raise Unclosed
        return at

    def until(self, sign: str, i: int, signs: re.Pattern, quoted: bool) -> int:
        while m := signs.search(self.text, i):
            c = m[0]
            if c == sign:
                return m.end()
            if c == "\\":
                i = m.end() + 1
            elif c == "'":
                i = self.past(None, m.end())
            else:
                i = self.expansion(m.start(), quoted)
        raise Unclosed

    def sum(self, i: int) -> int | None:
        """Past the two parentheses that close an arithmetic expression, None if it is none."""
        at = self.group(i)
        return at + 1 if self.text[at : at + 1] == ")" else None

    def group(self, i: int) -> int:
        """Past the parenthesis that closes the one before i."""
        depth = 1
        while m := IN_SUMS.search(self.text, i):
            c, i = m[0], m.end()
            if c == "\\":
                i += 1
            elif c == "'":
                i = self.past(None, i)
            elif c in "\"`$":
                i = self.expansion(m.start())
            else:
                depth += 1 if c == "(" else -1
                if not depth:
                    return i
        raise Unclosed


def shell_parts(text: str, words: set[str]) -> list[list[tuple[int, str]]]:
    """The plain rows of a script and of every command nested in it, each with its line; the script is the last."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * len(text) + 1000))
    shell = Shell(text, words)
    shell.command(0, "")
    return shell.parts
