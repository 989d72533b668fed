"""Cutting files into pieces of bounded size that give the text again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET = 800
#: Lines that begin a definition, by language; the last group is its name.
HEADS = {
    "python": r"[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+(\w+)", "go": r"func[ \t]+(?:\([^)]*\)[ \t]*)?(\w+)|type[ \t]+(\w+)", "rust": r"[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+|unsafe[ \t]+|const[ \t]+)*(?:fn|struct|enum|trait|impl)[ \t]+(\w+)",
    "javascript": r"[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(?:function\*?|class)[ \t]+(\w+)", "java": r"[ \t]*(?:(?:public|private|protected|static|final|abstract)[ \t]+)+[\w<>\[\], ]*?(\w+)[ \t]*(?:\(|\{|extends|implements)",
    "c": r"(?:static[ \t]+|inline[ \t]+)*[A-Za-z_][\w \t*]*?[ \t*](\w+)[ \t]*\([^;]*$", "bash": r"(?:function[ \t]+)?(\w+)[ \t]*\(\)", "sql": r"(?i:create)[ \t]+(?i:or replace[ \t]+)?(?i:table|view|function|index)[ \t]+(\w+)", "markdown": r"#{1,6}[ \t]+(.+)",
}
HEADS["typescript"] = HEADS["javascript"].replace("class)", "class|interface|enum)")


def estimate(text: str) -> int:
    """Tokens of a piece: its visible characters over 4, rounded up."""
    return -(-len(re.sub(r"\s", "", text)) // 4)


def cut(text: str, language: str | None, budget: int = BUDGET) -> list[tuple[int, int, str, str | None, str]]:
    """(start_line, end_line, node_type, symbol, text) of consecutive whole-line pieces.

    Definitions begin a new piece, blank lines before one go with it, and lines are packed
    until the sum of their estimates would pass the budget; a single larger line stays whole.
    Joined, the pieces give the text. An empty text has no pieces; a language without heads
    is cut by size alone.
    """
    if not text:
        return []
    head = re.compile(HEADS[language]) if language in HEADS else None
    lines = text.splitlines(keepends=True) if "\r" not in text and not re.search(r"[\x0b\x0c\x1c-\x1e\x85  ]", text) else re.findall(r"[^\n]*\n|[^\n]+$", text)
    starts: dict[int, str] = {}
    if head:
        for n, line in enumerate(lines):
            if m := head.match(line):
                at = n
                while at and (not lines[at - 1].strip() or lines[at - 1].lstrip().startswith("@")):
                    at -= 1
                starts.setdefault(at, next((g for g in m.groups() if g), ""))
    out, begin, size, symbol = [], 0, 0, starts.get(0)

    def close(end: int) -> None:
        kind = "definition" if symbol else "text"
        out.append((begin + 1, end, kind, symbol or None, "".join(lines[begin:end])))

    for n, line in enumerate(lines):
        cost = estimate(line)
        if n > begin and (n in starts or size + cost > budget):
            close(n)
            begin, size, symbol = n, 0, starts.get(n)
        size += cost
    close(len(lines))
    return out


def chunk_texts(rows: DataFrame, key: list[str], text: str, language: str | None = None, budget: int = BUDGET) -> DataFrame:
    """key, start_line, end_line, node_type, symbol, text, tokens of every piece. Each task cuts its own rows; null texts have none."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", start_line int, end_line int, node_type string, symbol string, text string, tokens bigint"
    lang = F.col(language) if language else F.lit(None).cast("string")
    narrow = rows.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("_text"), lang.alias("_language"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(*k, *p[:4], p[4], sum(map(estimate, p[4].splitlines()))) for *k, t, l in pdf[[*key, "_text", "_language"]].itertuples(index=False) for p in cut(t, l, budget)]
            yield pd.DataFrame(got, columns=[*key, "start_line", "end_line", "node_type", "symbol", "text", "tokens"])

    return narrow.mapInPandas(run, schema)
