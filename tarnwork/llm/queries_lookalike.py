"""Queries of the consistent text form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.lookalike import alike_classes, alike_pairs, consistent
from tarnwork.session import spread, table


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return alike_pairs(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes of documents that look the same, a row a document."""
    return alike_classes(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its consistent form."""
    return table(spark, d, "documents").select("doc_id", consistent(F.col("text")).alias("form"))


QUERIES = {"p9_found": p9_found, "p9_classes": p9_classes, "p9_forms": p9_forms}
SQL: dict[str, str] = {}
