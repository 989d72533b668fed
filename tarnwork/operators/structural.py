"""Structural search: code patterns with meta-variables over the texts of a table.

`$X` stands for one expression, `$$$X` for any number of them up to the closing bracket, or
at the end of a pattern for the rest of the block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.paths import under

TOKEN = re.compile(r"(?P<space>\s+)|(?P<comment>#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/)|(?P<text>[rbfuRBFU]{0,2}(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|`[^`]*`)|(?P<var>\${3}[A-Z_][A-Z0-9_]*|\$[A-Z_][A-Z0-9_]*)|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>=>|->|::|:=|[=!<>]=|&&|\|\||\S)")
OPEN, CLOSE = set("([{"), set(")]}")
COMMENTS = {"python": "#", "bash": "#", "yaml": "#", "toml": "#"}


def tokens(code: str, language: str) -> list[tuple[str, str, int, int]]:
    out = []
    hashes = COMMENTS.get(language) == "#"
    at = 0
    while m := TOKEN.match(code, at):
        kind, word, at = m.lastgroup, m[0], m.end()
        if kind == "comment" and (word[0] == "#") != hashes:
            at = m.start() + (2 if word[0] == "/" else 1)
            kind, word = "sign", code[m.start() : at]
        if kind not in ("space", "comment"):
            out.append((kind, word, m.start(), at))
    return out


class Pattern:
    """A compiled pattern; raises ValueError for one without tokens or with unbalanced brackets."""

    def __init__(self, pattern: str, language: str):
        self.language = language
        self.parts = [(k, w) for k, w, _, _ in tokens(pattern, language)]
        depth = 0
        for _, w in self.parts:
            depth += (w in OPEN) - (w in CLOSE)
            if depth < 0:
                break
        if not self.parts or depth or all(k == "var" for k, _ in self.parts):
            raise ValueError("the pattern has no code or unbalanced brackets")
        self.statement = self.parts[0][0] == "name" and len(self.parts) > 1 and self.parts[1][0] in ("var", "name")

    def literal(self) -> str:
        """The longest name in the pattern; a text without it can't match."""
        return max((w for k, w in self.parts if k == "name"), key=len, default="")

    def find(self, code: str) -> list[tuple[int, int, str, dict, dict]]:
        """(start_line, end_line, matched, singles, lists) of all matches that don't overlap."""
        toks, out, n = tokens(code, self.language), [], 0
        while n < len(toks):
            got = None
            if not self.statement or n == 0 or "\n" in code[toks[n - 1][3] : toks[n][2]] or toks[n - 1][1] in (";", "{", "}"):
                got = self.match(code, toks, n, 0, {}, {})
            if got is None:
                n += 1
                continue
            end, one, many = got
            a, b = toks[n][2], toks[end - 1][3]
            out.append((code.count("\n", 0, a) + 1, code.count("\n", 0, b) + 1, code[a:b], one, many))
            n = max(end, n + 1)
        return out

    def stop(self, code: str, toks: list, at: int, ends: set[str]) -> int:
        """The first token from `at` outside brackets that is in `ends`, closes a bracket or follows a line end outside them."""
        depth = 0
        start = at
        while at < len(toks):
            word = toks[at][1]
            if depth == 0 and (word in ends or word in CLOSE):
                break
            if depth == 0 and at > start and "\n" in code[toks[at - 1][3] : toks[at][2]] and ";" in ends:
                break
            depth += (word in OPEN) - (word in CLOSE)
            at += 1
        return at

    def match(self, code: str, toks: list, at: int, part: int, one: dict, many: dict):
        while part < len(self.parts):
            kind, word = self.parts[part]
            if kind != "var":
                if at >= len(toks) or toks[at][1] != word:
                    return None
                at, part = at + 1, part + 1
                continue
            if word.startswith("$$$"):
                if part == len(self.parts) - 1:
                    end = self.block_end(code, toks, at)
                    many[word[3:]] = [code[toks[at][2] : toks[end - 1][3]]] if end > at else []
                    return end, one, many
                items = []
                close = self.parts[part + 1][1]
                while at < len(toks) and toks[at][1] != close:
                    end = self.stop(code, toks, at, {",", close})
                    if end > at:
                        items.append(code[toks[at][2] : toks[end - 1][3]])
                    at = end + 1 if end < len(toks) and toks[end][1] == "," else end
                    if at == end and (at >= len(toks) or toks[at][1] != close):
                        return None
                many[word[3:]] = items
                part += 1
                continue
            after = {self.parts[part + 1][1]} if part + 1 < len(self.parts) else {";"}
            end = self.stop(code, toks, at, after | {","} | ({";"} if part + 1 == len(self.parts) else set()))
            if end == at:
                return None
            words = [(k in ("name", "number", "text"), w) for k, w, _, _ in toks[at:end]]
            if any(b[0] and b[1] not in OPERATORS and a[1] not in OPERATORS and (a[0] or a[1] in CLOSE) for a, b in zip(words, words[1:])):
                return None  # two operands side by side aren't one expression
            value = code[toks[at][2] : toks[end - 1][3]]
            if one.get(word[1:], value) != value:
                return None
            one[word[1:]] = value
            at, part = end, part + 1
        return at, one, many

    def block_end(self, code: str, toks: list, at: int) -> int:
        """Rest of an indented block: up to the first line that is not deeper than the line of the match's head."""
        if at >= len(toks):
            return at
        head = code.rfind("\n", 0, toks[at - 1][2]) + 1
        indent = len(code[head:]) - len(code[head:].lstrip(" \t"))
        while at < len(toks):
            line = code.rfind("\n", 0, toks[at][2]) + 1
            if line > head and code[line : toks[at][2]].strip() == "" and toks[at][2] - line <= indent:
                break
            at += 1
        return at


#: Words that may stand between two operands, or before one.
OPERATORS = {"and", "or", "not", "in", "is", "if", "else", "await", "lambda", "for", "new", "typeof", "instanceof", "as", "yield", "async", "return", "void", "delete", "mut", "move"}
MATCH = "start_line int, end_line int, matched string, singles map<string,string>, lists map<string,array<string>>"


def structural_search(rows: DataFrame, key: list[str], text: str, first_line: str, pattern: str, language: str) -> DataFrame:
    """key and a row per match. `first_line` is the file's line of a text's first character.

    A text without the longest name of the pattern is left out before Python sees it. The
    pattern is checked on the driver; a bad one raises ValueError. Null texts match nothing.
    """
    compiled = Pattern(pattern, language)
    kinds = dict(rows.dtypes)
    near = rows.where(F.col(text).contains(compiled.literal())).select(*key, F.col(text).alias("_text"), F.coalesce(first_line, F.lit(1)).alias("_line"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(*k, a + n - 1, b + n - 1, m, one, many) for *k, t, n in pdf[[*key, "_text", "_line"]].itertuples(index=False) for a, b, m, one, many in compiled.find(t)]
            yield pd.DataFrame(got, columns=[*key, "start_line", "end_line", "matched", "singles", "lists"])

    return near.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", " + MATCH)


def restricted_paths(paths: list[str]) -> list[str]:
    """Paths to search below, in one spelling; absolute ones, those that leave the project and empty ones raise ValueError."""
    out = []
    for p in paths:
        q = re.sub(r"/+", "/", p.replace("\\", "/")).strip()
        q = re.sub(r"^(?:\./)+", "", q).rstrip("/")
        if not q or q == "." or q.startswith("/") or ".." in q.split("/") or re.match(r"[A-Za-z]:", q):
            raise ValueError(f"not a path within the project: {p!r}")
        out.append(q)
    return out


def whole_files(pieces: DataFrame, key: list[str]) -> DataFrame:
    """key and the text of each file, its pieces in the order of their lines, each once. A row is one file's text."""
    each = pieces.select(*key, F.struct(F.coalesce("start_line", F.lit(1)).alias("n"), "chunk_id", F.coalesce("text", F.lit("")).alias("t")).alias("_p"))
    return each.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_set("_p")), lambda p: p["t"]), "").alias("text"))


def search_files(pieces: DataFrame, pattern: str, language: str, paths: list[str] | None = None, max_results: int | None = None) -> DataFrame:
    """project_id, path, file_hash and a row per match in whole files, so that matches over the border of two pieces are found.

    `pieces` needs project_id, path, file_hash, chunk_id, start_line, language, text. Only files with a
    piece that holds the pattern's longest name are put together. With `max_results` the first
    matches by path and line come, and `truncated` tells whether as many as that were found. A
    bad pattern, a bad path or a number below 1 raises ValueError before anything runs.
    """
    if max_results is not None and max_results < 1:
        raise ValueError("max_results must be at least 1")
    key = ["project_id", "path", "file_hash"]
    name = Pattern(pattern, language).literal()
    mine = pieces.where(F.lower("language") == language)
    if paths is not None:
        inside = F.lit(False)
        for p in restricted_paths(paths):
            inside = inside | under(F.col("path"), F.lit(p))
        mine = mine.where(inside)
    files = whole_files(mine.join(mine.where(F.col("text").contains(name)).select(*key).distinct(), key, "left_semi"), key)
    found = structural_search(files.withColumn("_first", F.lit(1)), key, "text", "_first", pattern, language)
    if max_results is None:
        return found.withColumn("truncated", F.lit(False))
    some = found.orderBy(*key, "start_line", "end_line", "matched").limit(max_results)
    return some.join(F.broadcast(some.agg((F.count("*") == max_results).alias("truncated"))))
