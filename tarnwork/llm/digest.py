"""Percentiles of very large numeric columns by merging centroid digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELTA = 400
FLUSH = 200_000
BROADCAST_GROUPS = 50_000
SALTS = 16
#: Partitions whose digests are merged in one part of a group.
SALTED = 64


def clusters(values: np.ndarray, weights: np.ndarray, delta: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of sorted values: those whose mid-quantile falls in one unit of the arcsine size function share one.

    The function is steep at both ends, so the tails keep single values.
    """
    total = weights.sum()
    mid = (np.cumsum(weights) - weights / 2) / total
    unit = np.floor(delta * (np.arcsin(2 * mid - 1) / np.pi + 0.5)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    w = np.add.reduceat(weights, starts)
    return np.add.reduceat(values * weights, starts) / w, w


def partial_digests(rows: DataFrame, group: list[str], value: str, delta: int = DELTA) -> DataFrame:
    """Each task's centroids per group: the group columns, `mean` and `weight`.

    A task clusters and gives out its values whenever it holds FLUSH of them, so every value is
    clustered once, however many rows it reads; nothing is shuffled. `value` must not be null or NaN.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*group).dtypes) + ", mean double, weight double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def settle() -> Iterator[pd.DataFrame]:
            for k, part in pd.concat(held).groupby(group, dropna=False, sort=False):
                v = np.sort(part[value].to_numpy(np.float64))
                m, w = clusters(v, np.ones(len(v)), delta)
                yield pd.DataFrame({c: pd.Series([None if pd.isna(x) else x] * len(m), dtype=part[c].dtype) for c, x in zip(group, k)} | {"mean": m, "weight": w})
            held.clear()

        count = 0
        for pdf in batches:
            if len(pdf):
                held.append(pdf)
                count += len(pdf)
            if count >= FLUSH:
                yield from settle()
                count = 0
        if held:
            yield from settle()

    return rows.select(*group, value).mapInPandas(run, schema)


def merge_digests(centroids: DataFrame, group: list[str], delta: int = DELTA, salted: bool = True) -> DataFrame:
    """Digests merged by re-clustering their centroids, first in parts of each group from SALTED partitions each.

    Result: group, `mean`, `weight`. Partial results of other days or partitions are merged by
    a union of their rows and another call, without parts where they are few. Each call is
    one clustering more (two with parts) in `rank_bound`.
    """

    def recluster(df: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("mean", "weight").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*by)
        mid = (F.sum("weight").over(order) - F.col("weight") / 2) / F.sum("weight").over(whole)
        unit = F.floor(delta * (F.asin(F.least(2 * mid - 1, F.lit(1.0))) / np.pi + 0.5))
        return (
            df.withColumn("_unit", unit)
            .groupBy(*by, "_unit")
            .agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("weight"))
            .drop("_unit")
        )

    if not salted:
        return recluster(centroids, group).select(*group, "mean", "weight")
    part = F.floor(F.spark_partition_id() / SALTED)
    return recluster(recluster(centroids.withColumn("_salt", part), [*group, "_salt"]).drop("_salt"), group).select(*group, "mean", "weight")


def estimates(digest: DataFrame, group: list[str], quantiles: list[float]) -> DataFrame:
    """One row per group: `n` and `est`, the values at the quantiles, linear between centroid centres."""
    order = Window.partitionBy(*group).orderBy("mean", "weight")
    to_here = order.rowsBetween(Window.unboundedPreceding, 0)
    centres = digest.select(*group, "mean", (F.sum("weight").over(to_here) - F.col("weight") / 2).alias("_at"), F.sum("weight").over(Window.partitionBy(*group)).alias("_n"))
    centres = centres.withColumns({"_next": F.lead("_at").over(order2 := Window.partitionBy(*group).orderBy("_at")), "_mean2": F.lead("mean").over(order2), "_first": F.lag("_at").over(order2).isNull()})

    def value(q: float) -> Column:
        at = F.col("_n") * q
        inside = (F.col("_at") <= at) & (F.col("_next") > at)
        slope = (F.col("_mean2") - F.col("mean")) / (F.col("_next") - F.col("_at"))
        between = F.when(inside, F.col("mean") + (at - F.col("_at")) * slope)
        ends = F.when((F.col("_first") & (at < F.col("_at"))) | (F.col("_next").isNull() & (at >= F.col("_at"))), F.col("mean"))
        return F.max(F.coalesce(between, ends))

    return centres.groupBy(*group).agg(F.max("_n").cast("bigint").alias("n"), F.array(*[value(q) for q in quantiles]).alias("est"))


def rank_bound(q: float, delta: int = DELTA, clusterings: int = 3) -> float:
    """Stated bound on the rank error as a share of n, besides one row.

    A centroid of one clustering spans about pi/delta * sqrt(q(1-q)) of the ranks, and the
    clusterings a value goes through add up: three up to a merged digest (in the task, in a part,
    in the group), one more for each union of stored digests.
    """
    return clusterings * np.pi / delta * float(np.sqrt(q * (1 - q)))


def certify(rows: DataFrame, group: list[str], value: str, est: DataFrame, quantiles: list[float], groups: int, salts: int = SALTS) -> DataFrame:
    """Second pass: for each group the exact number of values below and at each estimate.

    `est` has one row per group and is broadcast while `groups`, its counted size, is at most
    BROADCAST_GROUPS; beyond it is joined by group and salt. Result: est's columns, `below` and
    `upto` arrays.
    """
    if groups <= BROADCAST_GROUPS:
        met = rows.join(F.broadcast(est), group)
    else:
        salt = F.pmod(F.hash(value), F.lit(salts))
        wide = est.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = rows.withColumn("_salt", salt).join(wide, [*group, "_salt"]).drop("_salt")
    n = len(quantiles)
    at = lambda i: F.col("est")[i]
    counts = [c for i in range(n) for c in (F.count_if(F.col(value) < at(i)).alias(f"_b{i}"), F.count_if(F.col(value) <= at(i)).alias(f"_u{i}"))]
    return met.groupBy(*group).agg(*counts).select(*group, F.array(*[f"_b{i}" for i in range(n)]).alias("below"), F.array(*[f"_u{i}" for i in range(n)]).alias("upto"))


def measurements(log: DataFrame, id_col: str, value: str, keep: list[str]) -> DataFrame:
    """Each id once, with a finite or infinite value; null and NaN are no measurements.

    Of the rows of an id the first usable one counts, by the kept columns and the value. Rows
    without an id are all kept.
    """
    usable = log.where(F.col(value).isNotNull() & ~F.isnan(value)).select(id_col, *keep, value)
    known = usable.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.struct(*keep, value)).alias("_r"))
    return known.select("_r.*").unionByName(usable.where(F.col(id_col).isNull()).select(*keep, value))
