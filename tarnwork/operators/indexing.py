"""Keeping an index in step with its files: diffs, drift, orphans, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.paths import ancestors


def hash_diff(stored: DataFrame, found: DataFrame, key: list[str], content: str) -> DataFrame:
    """key, bucket in new, changed, unchanged, deleted; one row per key of either side. Of repeated keys the largest content counts; content is compared null-safe."""
    s = stored.groupBy(*key).agg(F.max(content).alias("_s"), F.lit(True).alias("_in_s"))
    f = found.groupBy(*key).agg(F.max(content).alias("_f"), F.lit(True).alias("_in_f"))
    bucket = F.when(F.col("_in_s").isNull(), "new").when(F.col("_in_f").isNull(), "deleted").when(F.col("_s").eqNullSafe(F.col("_f")), "unchanged").otherwise("changed")
    return s.join(f, key, "full").select(*key, bucket.alias("bucket"))


def restrict(found: DataFrame, stored: DataFrame, candidates: DataFrame, key: list[str]) -> DataFrame:
    """Rows of found that must be hashed: candidates, and whatever the store doesn't know."""
    c = candidates.select(*key, F.lit(True).alias("_c")).distinct()
    s = stored.select(*key, F.lit(True).alias("_s")).distinct()
    return found.join(c, key, "left").join(s, key, "left").where(F.col("_c").isNotNull() | F.col("_s").isNull()).drop("_c", "_s")


def drift(files: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """Files whose stored chunk_count isn't their number of distinct points; files without points have 0."""
    n = points.select(*key, "chunk_id").distinct().groupBy(*key).agg(F.count("*").alias("points"))
    met = files.select(*key, "chunk_count").distinct().join(n, key, "left").fillna(0, ["points"])
    return met.where(F.col("points") != F.col("chunk_count"))


def with_ancestor(rows: DataFrame, prefixes: DataFrame, by: list[str], path: str = "path", prefix: str = "prefix") -> DataFrame:
    """Each row with every prefix that is its path or a directory above it.

    An equi-join on the exploded ancestors instead of a nested loop over prefixes.
    """
    above = F.concat(ancestors(F.col(path)), F.array(path))
    return rows.withColumn(prefix, F.explode(above)).join(prefixes.select(*by, prefix).distinct(), [*by, prefix])


def orphans(points: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """Points of files that the state doesn't list."""
    return points.join(files.select(*key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old snapshot with the rows of new in place of those with the same key; the last of several new rows by all columns."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in key]
    picked = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_new", *[c for c, t in old.dtypes if c in rest and not t.startswith("map")])).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def prune(points: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """points without those of listed files that carry another hash than the file's current one."""
    current = files.select(*key, F.col("content_hash").alias("_keep")).distinct()
    met = points.join(current, key, "left")
    return met.where(F.col("_keep").isNull() | F.col("file_hash").eqNullSafe(F.col("_keep"))).drop("_keep")


def sweep(points: DataFrame, live: DataFrame, owner: str = "project_id") -> DataFrame:
    """points of live owners only; refuses an empty live set, which would empty the store."""
    if live.limit(1).count() == 0:
        raise ValueError("no live owners: refusing to remove every point")
    return points.join(live.select(owner).distinct(), owner, "left_semi")


def gaps(pieces: DataFrame, key: list[str]) -> DataFrame:
    """Files whose pieces don't follow each other line by line: key, pieces, breaks."""
    order = Window.partitionBy(*key).orderBy("start_line")
    step = pieces.select(*key, "chunk_id", "start_line", "end_line").distinct().withColumn("_last", F.lag("end_line").over(order))
    broken = F.when(F.col("_last").isNull(), F.col("start_line") != 1).otherwise(F.col("start_line") != F.col("_last") + 1)
    return step.groupBy(*key).agg(F.count("*").alias("pieces"), F.count_if(broken).alias("breaks"))


def ledger(old: DataFrame, reported: DataFrame, cleared: DataFrame, key: list[str], limit: int) -> DataFrame:
    """Counters of consecutive failures after one more run: reported keys count one up, cleared keys go, quarantine at the limit."""
    r = reported.select(*key, F.lit(True).alias("_r")).distinct()
    c = cleared.select(*key, F.lit(True).alias("_c")).distinct()
    met = old.join(r, key, "full").join(c, key, "left").where(F.col("_c").isNull() | F.col("_r").isNotNull())
    runs: Column = F.coalesce("runs", F.lit(0)) + F.when(F.col("_r"), 1).otherwise(0)
    return met.select(*key, runs.cast("bigint").alias("runs")).withColumn("quarantined", F.col("runs") >= limit)
