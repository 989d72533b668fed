"""Usage reports over a query log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_day(log: DataFrame) -> DataFrame:
    """Queries per UTC day by kind, interface and reranking."""
    has = lambda c, v: F.count_if(F.col(c) == v)
    return log.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("queries"), has("kind", "search").alias("searches"), has("kind", "structural").alias("structural"),
        has("interface", "rest").alias("rest"), has("interface", "mcp").alias("mcp"), F.count_if("reranked").alias("reranked"),
    )


def day_spine(days: DataFrame, counts: list[str]) -> DataFrame:
    """days with a zero row for every day between the first and the last that has none."""
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(days, "day", "left").fillna(0, counts)


def channel_mix(log: DataFrame) -> DataFrame:
    """Queries per channel; those without one are structural."""
    return log.groupBy(F.coalesce("channel", F.lit("structural")).alias("channel")).agg(F.count("*").alias("queries"))


def index_health(projects: DataFrame, files: DataFrame, points: DataFrame, log: DataFrame) -> DataFrame:
    """Every project with its files, expected and stored pieces and its last query; counts are 0 where there is nothing."""
    f = files.groupBy("project_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("expected"))
    p = points.groupBy("project_id").agg(F.count("*").alias("points"))
    q = log.groupBy("project_id").agg(F.count("*").alias("queries"), F.max("ts").alias("last_query"))
    out = projects.select(F.col("id").alias("project_id"))
    for side in (f, p, q):
        out = out.join(side, "project_id", "left")
    return out.fillna(0, ["files", "expected", "points", "queries"])
