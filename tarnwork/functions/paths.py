"""Column expressions on relative paths."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfc(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in paths:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def canonical_path(path: Column) -> Column:
    """One spelling per file: `/` separators, no leading `./`, composed characters.

    ASCII paths stay in the JVM; only the others carry their text to Python. Null stays null.
    """
    slashed = F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")
    return F.coalesce(_nfc(F.when(slashed.rlike(r"[^\x00-\x7F]"), slashed)), slashed)


def ancestors(path: Column) -> Column:
    """All proper ancestor directories, nearest the root first; empty for a top-level file."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    )


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased last suffix of the file name with its dot; '' for none or for a leading dot only."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def under(path: Column, prefix: Column) -> Column:
    """path is prefix itself or lies below it; `src` does not hold `src2/x`."""
    return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))
