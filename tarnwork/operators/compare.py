"""Differences between two copies of the same data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_copies(left: DataFrame, right: DataFrame, key: list[str], fields: list[str], part: str, carry: list[str] | None = None) -> DataFrame:
    """Both copies side by side, and the fields on which they disagree.

    The union of both copies is range-partitioned with shared split points over the key, the
    side and `part`, the column that tells a key's rows apart, so a key with very many rows is
    split as well. Partitions are sorted, and two aggregations over the sorted run are the
    streaming merge: repeated rows of a part to one, then the key's parts of both sides to one.
    What a partition has of a key is one row when the ends of partitions are put together.

    Result: key, in_left, in_right, `parts_right` (distinct parts), `<carry>_min` and `_max` over
    the left rows, and `unequal`, the names of the fields that differ for keys on both sides.

    - A field agrees if every value on both sides is the same, or all are null.
    - A null in the key is a value like any other; a null part counts as no part. Empty copies are fine.
    - Repeated rows count once; columns not named here are not read.
    """
    carry = carry or []
    side = lambda df, n: df.select(*key, F.lit(n).alias("_side"), F.col(part).alias("_part") if part in df.columns else F.lit(None).cast(dict(right.dtypes)[part]).alias("_part"), *fields, *[F.col(c) if n == 0 else F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in carry])
    at = [*key, "_side", "_part"]
    run = side(left, 0).unionByName(side(right, 1)).repartitionByRange(*at).sortWithinPartitions(*at)
    ends = [x for f in (*fields, *carry) for x in (F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max"))]
    piece = run.groupBy(*at).agg(*ends, *[F.max(F.col(f).isNull()).alias(f"{f}_null") for f in fields])
    here = lambda n, c: F.when(F.col("_side") == n, c)
    sides = [
        e.alias(f"_{f}_{n}_{x}")
        for f in fields for n in (0, 1)
        for x, e in (("min", F.min(here(n, F.col(f"{f}_min")))), ("max", F.max(here(n, F.col(f"{f}_max")))), ("null", F.max(here(n, F.col(f"{f}_null")))))
    ]
    met = piece.groupBy(*key).agg(
        F.max(F.col("_side") == 0).alias("in_left"), F.max(F.col("_side") == 1).alias("in_right"), F.count(here(1, F.col("_part"))).alias("parts_right"),
        *[g(here(0, F.col(f"{c}_{x}"))).alias(f"{c}_{x}") for c in carry for x, g in (("min", F.min), ("max", F.max))], *sides,
    )

    def same(f: str) -> Column:
        lo, hi, no, lo2, hi2, no2 = (F.col(f"_{f}_{n}_{x}") for n in (0, 1) for x in ("min", "max", "null"))
        return lo.eqNullSafe(lo2) & hi.eqNullSafe(hi2) & lo.eqNullSafe(hi) & no.eqNullSafe(no2) & ~(no & lo.isNotNull())

    unequal = F.filter(F.array(*[F.when(~same(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return met.select(
        *key, "in_left", "in_right", "parts_right", *[f"{c}_{x}" for c in carry for x in ("min", "max")],
        F.when(F.col("in_left") & F.col("in_right"), unequal).otherwise(F.array().cast("array<string>")).alias("unequal"),
    )


def state_against_store(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The state store's files against the vector store's pieces: project_id, path, difference.

    `files` needs project_id, path, chunk_count, content_hash, language; `chunks` needs
    project_id, path, chunk_id, file_hash, language; paths are canonical. A null chunk_count
    is 0. A file with count 0 and no piece agrees.
    """
    key, fields = ["project_id", "path"], ["content_hash", "language"]
    state = files.select(*key, F.coalesce("chunk_count", F.lit(0)).cast("bigint").alias("chunk_count"), *fields)
    pieces = chunks.select(*key, "chunk_id", F.col("file_hash").alias("content_hash"), "language")
    met = merge_copies(state, pieces, key, fields, "chunk_id", carry=["chunk_count"])
    counted = (F.col("chunk_count_min") == F.col("parts_right")) & (F.col("chunk_count_max") == F.col("parts_right"))
    what = (
        F.when(~F.col("in_right"), F.when(F.col("chunk_count_max") > 0, F.array(F.lit("missing_in_store"))))
        .when(~F.col("in_left"), F.array(F.lit("missing_in_state")))
        .otherwise(F.concat(F.when(~counted, F.array(F.lit("chunk_count"))).otherwise(F.array().cast("array<string>")), F.col("unequal")))
    )
    return met.select(*key, F.explode(what).alias("difference"))
