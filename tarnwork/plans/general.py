"""Registered queries for snapshots and copies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.paths import canonical_path
from tarnwork.operators.compare import state_against_store
from tarnwork.operators.snapshots import snapshot_changes
from tarnwork.session import table

SQL_PATH = r"nfc_normalize(regexp_replace(replace({0}, '\', '/'), '^(\./)+', ''))"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "file_snapshots").select(
        "snapshot_no", "project_id", canonical_path(F.col("path")).alias("path"), F.lower("content_hash").alias("content_hash"), "last_indexed_at"
    )
    return snapshot_changes(rows, "snapshot_no", ["project_id", "path"], "content_hash", "last_indexed_at")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Changes per delivery and project."""
    return p4_found(spark, d).groupBy("snapshot_no", "project_id").agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")]
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").select("project_id", canonical_path(F.col("path")).alias("path"), "chunk_count", "content_hash", "language")
    chunks = table(spark, d, "chunks").select("project_id", canonical_path(F.col("file_path")).alias("path"), "chunk_id", "file_hash", "language")
    return state_against_store(files, chunks)


_P4 = f"""
WITH r AS (
  SELECT snapshot_no, project_id, {SQL_PATH.format("path")} AS path,
         arg_max(lower(content_hash), coalesce(last_indexed_at, TIMESTAMPTZ '1900-01-01')) AS h
  FROM file_snapshots GROUP BY 1, 2, 3),
n AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS nxt FROM (SELECT DISTINCT snapshot_no FROM file_snapshots)),
a AS (SELECT n.nxt AS s, r.* FROM r JOIN n USING (snapshot_no) WHERE n.nxt IS NOT NULL),
b AS (SELECT snapshot_no AS s, project_id, path, h FROM r WHERE snapshot_no > (SELECT min(snapshot_no) FROM n)),
found AS (
  SELECT coalesce(a.s, b.s) AS snapshot_no, coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.path, b.path) AS path,
         CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM a FULL JOIN b ON a.s = b.s AND a.project_id = b.project_id AND a.path = b.path
  WHERE a.s IS NULL OR b.s IS NULL OR a.h <> b.h)
"""

QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts, "p6_found": p6_found}

SQL = {
    "p4_found": _P4 + "SELECT * FROM found",
    "p4_counts": _P4
    + """SELECT snapshot_no, project_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
         count(*) FILTER (change = 'changed') AS changed FROM found GROUP BY 1, 2""",
    "p6_found": f"""
WITH f AS (SELECT DISTINCT project_id, {SQL_PATH.format("path")} AS path, chunk_count, content_hash, language FROM files),
c AS (SELECT DISTINCT project_id, {SQL_PATH.format("file_path")} AS path, chunk_id, file_hash, language FROM chunks),
k AS (SELECT project_id, path, count(DISTINCT chunk_id) AS n FROM c GROUP BY 1, 2)
SELECT f.project_id, f.path, 'missing_in_store' AS difference FROM f LEFT JOIN k USING (project_id, path) WHERE k.n IS NULL AND f.chunk_count > 0
UNION SELECT k.project_id, k.path, 'missing_in_state' FROM k LEFT JOIN f USING (project_id, path) WHERE f.content_hash IS NULL
UNION SELECT f.project_id, f.path, 'chunk_count' FROM f JOIN k USING (project_id, path) WHERE f.chunk_count <> k.n
UNION SELECT f.project_id, f.path, 'content_hash' FROM f JOIN c USING (project_id, path) WHERE f.content_hash <> c.file_hash
UNION SELECT f.project_id, f.path, 'language' FROM f JOIN c USING (project_id, path) WHERE f.language IS DISTINCT FROM c.language
""",
}
