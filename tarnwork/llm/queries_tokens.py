"""Queries of the corpus encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.tokens import encode_corpus
from tarnwork.session import spread, table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")))


def p7_source_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and characters per source."""
    ids = encode_corpus(table(spark, d, "documents").withColumn("doc_id", F.struct("source", F.char_length(F.coalesce("text", F.lit(""))).alias("chars"))))
    return ids.groupBy(F.col("doc_id.source").alias("source")).agg(F.count("*").alias("docs"), F.sum("doc_id.chars").alias("chars"), F.sum(F.size("ids")).alias("tokens"))


QUERIES = {"p7_ids": p7_ids, "p7_source_sizes": p7_source_sizes}
SQL: dict[str, str] = {}
