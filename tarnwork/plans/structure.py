"""Registered queries for cutting texts and structural search, with their SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.paths import canonical_path
from tarnwork.operators.chunking import chunk_texts
from tarnwork.operators.structural import search_files
from tarnwork.session import spread, table


def chunked_documents(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every document."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("language", F.lit("markdown"))
    return chunk_texts(docs, ["doc_id"], "text", "language").drop("text")


def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Characters and lines that the pieces of each document give again."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("language", F.lit("markdown"))
    got = chunk_texts(docs, ["doc_id"], "text", "language")
    return got.groupBy("doc_id").agg(F.sum(F.char_length("text")).alias("chars"), F.max("end_line").alias("lines"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").withColumn("path", canonical_path(F.col("file_path"))).select("project_id", "path", "file_hash", "chunk_id", "start_line", "language", "text")


def structural_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of log_event per project, and how many arguments they have in all."""
    found = search_files(_pieces(spark, d), "log_event($$$ARGS)", "python")
    return found.groupBy("project_id").agg(F.count("*").alias("calls"), F.sum(F.size(F.col("lists")["ARGS"])).alias("arguments"))


def structural_imports(spark: SparkSession, d: str) -> DataFrame:
    """What plain import statements name."""
    found = search_files(_pieces(spark, d), "import $MOD", "python")
    return found.groupBy(F.col("singles")["MOD"].alias("module")).agg(F.count("*").alias("imports"))


def structural_first(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 functions below src, by path and line."""
    found = search_files(_pieces(spark, d), "def $NAME($$$PARAMS): $$$BODY", "python", paths=["src"], max_results=100)
    return found.select("project_id", "path", "start_line", F.col("singles")["NAME"].alias("name"), "truncated")


_PY = "p AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE lower(language) = 'python')"
QUERIES = {f.__name__: f for f in (chunked_documents, chunk_coverage, structural_calls, structural_imports, structural_first)}
SQL = {
    "chunk_coverage": "SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, chr(10), '')) + CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END AS lines FROM documents WHERE text IS NOT NULL AND text <> ''",
    "structural_imports": rf"WITH {_PY}, m AS (SELECT unnest(regexp_extract_all(text, '(?m)^[ \t]*import[ \t]+([\w.]+)[ \t]*(?:;|$)', 1)) AS module FROM p) SELECT module, count(*) AS imports FROM m GROUP BY 1",
}
