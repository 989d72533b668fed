"""Queries of the credential finder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.credentials import find_credentials, redact
from tarnwork.session import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = spread(table(spark, d, "chunks").select("chunk_id", "file_path", "start_line", "text"))
    return find_credentials(chunks).select("chunk_id", "line_no")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every row of chunks with its credentials masked; nothing is shuffled, repeated rows stay."""
    return redact(spread(table(spark, d, "chunks").select("chunk_id", "file_path", "text"))).select("chunk_id", "text")


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Credentials per project and kind."""
    owner = table(spark, d, "chunks").select("chunk_id", "project_id").distinct()
    return find_credentials(table(spark, d, "chunks")).join(owner, "chunk_id").groupBy("project_id", "kind").agg(F.count("*").alias("credentials"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p1_kinds": p1_kinds}
SQL: dict[str, str] = {}
