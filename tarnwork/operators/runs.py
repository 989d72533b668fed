"""Questions about a log of runs: the latest, streaks, and what came since."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(runs: DataFrame, owner: str, at: list[str]) -> DataFrame:
    """The last run of each owner in the order of the columns `at`; aggregated, not sorted."""
    rest = [c for c in runs.columns if c != owner]
    return runs.groupBy(owner).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_r")).select(owner, "_r.*")


def since_last(runs: DataFrame, owner: str, at: list[str], mark: str) -> DataFrame:
    """Per owner the runs after the last one that satisfies the condition `mark`; all runs if none does."""
    last = runs.groupBy(owner).agg(F.max(F.when(F.expr(mark), F.struct(*at))).alias("_last"))
    met = runs.join(last, owner)
    after = F.col("_last").isNull() | (F.struct(*at) > F.col("_last"))
    return met.groupBy(owner).agg(F.count_if(after).alias("since"))


def streaks(runs: DataFrame, owner: str, at: list[str], failing: str) -> DataFrame:
    """Per owner the longest row of consecutive failing runs and the one that lasts until now."""
    order = Window.partitionBy(owner).orderBy(*at)
    bad = F.expr(failing)
    marked = runs.select(owner, *at, bad.alias("_bad")).withColumn("_island", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = marked.groupBy(owner, "_island").agg(F.count_if("_bad").alias("_n"))
    return islands.groupBy(owner).agg(F.max("_n").alias("longest"), F.max_by("_n", "_island").alias("current"))
