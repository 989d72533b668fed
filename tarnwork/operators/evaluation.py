"""Quality of ranked results against relevance labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_per_file(hits: DataFrame, query: str = "query_id", file: str = "file", rank: str = "rank") -> DataFrame:
    """Each file once per query, at its best rank, ranked anew from 1."""
    best = hits.groupBy(query, file).agg(F.min(rank).alias("_best"))
    return best.withColumn(rank, F.row_number().over(Window.partitionBy(query).orderBy("_best", file))).drop("_best")


def relevant_hits(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Hits that meet a label: same query and file, and overlapping lines where the label has lines (bounds inclusive)."""
    h, r = hits.alias("h"), labels.alias("r")
    lines = F.col("r.start_line").isNull() | ((F.col("h.start_line") <= F.col("r.end_line")) & (F.col("h.end_line") >= F.col("r.start_line")))
    return h.join(r, (F.col("h.query_id") == F.col("r.query_id")) & (F.col("h.file") == F.col("r.file")) & lines, "left_semi")


def query_metrics(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """recall_5, recall_10 and ndcg_10 per query; `hits` has query_id, id, rank from 1, `labels` has query_id, id, category.

    Every labelled query has a row, also without hits. Gains are 0 or 1, discounted by log2(rank + 1).
    """
    marked = labels.select("query_id", "category", "id").distinct()
    found = hits.select("query_id", "id", "rank").join(marked.select("query_id", "id"), ["query_id", "id"], "left_semi")
    return counted_metrics(marked.groupBy("query_id", "category").agg(F.count("*").alias("relevant")), found)


def counted_metrics(asked: DataFrame, found: DataFrame) -> DataFrame:
    """As query_metrics, from the number of relevant rows per query (query_id, category, relevant) and its relevant hits (query_id, rank).

    For labels that are classes of rows: the rows of a class are counted, not listed.
    """
    at = found.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= 5).alias("h5"), F.count_if(F.col("rank") <= 10).alias("h10"), F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
    )
    per = asked.join(at, "query_id", "left").fillna(0, ["h5", "h10", "dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return per.select("query_id", "category", (F.col("h5") / F.col("relevant")).alias("recall_5"), (F.col("h10") / F.col("relevant")).alias("recall_10"), (F.col("dcg") / ideal).alias("ndcg_10"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """Means per category and over all queries (category null)."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("recall_5", "recall_10", "ndcg_10")]
    return per_query.rollup("category").agg(F.count("*").alias("queries"), *means)
