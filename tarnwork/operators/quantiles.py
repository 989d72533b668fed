"""Exact order statistics per group without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.session import cut


def exact_at(rows: DataFrame, group: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """group, n and, for each name of ranks, the value at that rank.

    A rank is a 1-based position as an expression of `n`. Values are counted, range-partitioned
    and numbered within partitions; the positions of a partition follow from the totals of
    those before it, so a group of any size is spread over all tasks. Null values are left out.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    placed = cut(counts.repartitionByRange(parts, *group, value).withColumn("_p", F.spark_partition_id()))
    totals = placed.groupBy(*group, "_p").agg(F.sum("_c").alias("_t"))
    before = totals.withColumn("_before", F.sum("_t").over(Window.partitionBy(*group).orderBy("_p")) - F.col("_t")).withColumn("n", F.sum("_t").over(Window.partitionBy(*group)))
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group] + [F.col("a._p") == F.col("b._p")]
    met = placed.alias("a").join(before.alias("b"), on).select("a.*", "b._before", "b.n")
    to = F.col("_before") + F.sum("_c").over(Window.partitionBy(*group, "_p").orderBy(value))
    numbered = met.withColumn("_to", to).withColumn("_from", F.col("_to") - F.col("_c"))
    pick = lambda r: F.max(F.when((F.col("_from") < r) & (F.col("_to") >= r), F.col(value)))
    return numbered.groupBy(*group).agg(F.max("n").alias("n"), *[pick(r).alias(name) for name, r in ranks.items()])


def nearest_rank(p: float) -> Column:
    """Position of the nearest-rank percentile: ceil(p * n), at least 1."""
    return F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1))


def index_position(p: float) -> Column:
    """Position p * (n - 1), rounded half to even, counted from 0."""
    return F.bround(F.lit(p) * (F.col("n") - 1)).cast("bigint") + 1
