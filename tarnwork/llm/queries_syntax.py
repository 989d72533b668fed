"""Queries of the syntax check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.paths import canonical_path
from tarnwork.llm.syntax import check_syntax, failure_rates
from tarnwork.session import table


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").select("project_id", canonical_path(F.col("path")).alias("path"), "language", "content_hash", "chunk_count")
    chunks = table(spark, d, "chunks").select("project_id", canonical_path(F.col("file_path")).alias("path"), "file_hash", "chunk_id", "start_line", "text")
    return check_syntax(files, chunks)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).where(~F.col("ok")).select("project_id", "path")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Failing files and their rate per project and language."""
    return failure_rates(_verdicts(spark, d))


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates}
SQL: dict[str, str] = {}
