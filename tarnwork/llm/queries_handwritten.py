"""Queries of the hand-written filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.paths import canonical_path
from tarnwork.llm.handwritten import known_files, not_hand_written, piece_marks, rules_of
from tarnwork.session import cut, spread, table

PROGRAMS = ["python", "javascript", "typescript", "go", "java", "rust", "c", "sql"]


def _read(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, d, "files").select("project_id", canonical_path(F.col("path")).alias("path"), "language", "content_hash")
    chunks = spread(table(spark, d, "chunks").select("project_id", "file_path", "file_hash", "chunk_id", "start_line", "text")).select("project_id", canonical_path(F.col("file_path")).alias("path"), "file_hash", "chunk_id", "start_line", "text")
    return files, cut(piece_marks(chunks))


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    files, pieces = _read(spark, d)
    return not_hand_written(files, pieces, PROGRAMS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _reasons(spark, d).select("project_id", "path")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many files are not hand-written, by project and reason."""
    return _reasons(spark, d).groupBy("project_id", "reason").agg(F.count("*").alias("files"))


def p5_rules(spark: SparkSession, d: str) -> DataFrame:
    """The mined rules: directory names, endings of file names, and words of first comments (`# `)."""
    files, pieces = _read(spark, d)
    return rules_of(known_files(files, pieces, PROGRAMS))


QUERIES = {"p5_found": p5_found, "p5_reasons": p5_reasons, "p5_rules": p5_rules}
SQL: dict[str, str] = {}
