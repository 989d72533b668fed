"""Registered queries for the index pipeline, with their SQL."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.globs import EXCLUDED_DIRS, LOCK_FILES, SECRET_FILES, glob_regex
from tarnwork.functions.hashing import pseudo_vector, uuid5
from tarnwork.functions.paths import ancestors, basename, canonical_path
from tarnwork.functions.text import language_of, snippet, token_estimate
from tarnwork.operators import indexing as I
from tarnwork.plans.general import SQL_PATH
from tarnwork.session import table

KEY = ["project_id", "path"]
NAMESPACE = UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").withColumn("path", canonical_path(F.col("path"))).select(*KEY, "language", "content_hash", "chunk_count").distinct()


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").withColumn("path", canonical_path(F.col("file_path"))).drop("file_path")


def _last_snapshot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "file_snapshots").withColumn("path", canonical_path(F.col("path")))
    last = rows.agg(F.max("snapshot_no").alias("snapshot_no"))
    rows = rows.join(F.broadcast(last), "snapshot_no")
    return rows.groupBy(*KEY).agg(F.max_by(F.lower("content_hash"), F.coalesce("last_indexed_at", F.lit("1900-01-01").cast("timestamp"))).alias("content_hash"))


def index_hash_diff(spark: SparkSession, d: str) -> DataFrame:
    """The stored files against the last delivered file list."""
    return I.hash_diff(_files(spark, d), _last_snapshot(spark, d), KEY, "content_hash")


def index_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What an incremental run looks at: changed or new files, drifted files, and files of orphaned pieces."""
    files, chunks = _files(spark, d), _chunks(spark, d)
    moved = index_hash_diff(spark, d).where(F.col("bucket").isin("new", "changed")).select(*KEY)
    return moved.unionByName(I.drift(files, chunks, KEY).select(*KEY)).unionByName(I.orphans(chunks, files, KEY).select(*KEY)).distinct()


def index_restricted(spark: SparkSession, d: str) -> DataFrame:
    """Files of the last list that must be hashed when only drifted files are candidates."""
    files = _files(spark, d)
    return I.restrict(_last_snapshot(spark, d).select(*KEY), files, I.drift(files, _chunks(spark, d), KEY), KEY)


def index_drift(spark: SparkSession, d: str) -> DataFrame:
    return I.drift(_files(spark, d), _chunks(spark, d), KEY)


def index_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of files that the state doesn't list."""
    return I.orphans(_chunks(spark, d), _files(spark, d), KEY).select("chunk_id", *KEY).distinct()


def index_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Pieces per project after those of outdated file versions are gone."""
    kept = I.prune(_chunks(spark, d).select("chunk_id", *KEY, "file_hash").distinct(), _files(spark, d), KEY)
    return kept.groupBy("project_id").agg(F.count("*").alias("points"))


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The file state after the last list was written over it: files per project and how many hold the list's hash."""
    old = _files(spark, d).select(*KEY, "content_hash").withColumn("origin", F.lit("state"))
    new = _last_snapshot(spark, d).withColumn("origin", F.lit("list"))
    return I.upsert(old, new, KEY).groupBy("project_id").agg(F.count("*").alias("files"), F.count_if(F.col("origin") == "list").alias("replaced"))


def index_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of the current version of each file follow each other."""
    current = _chunks(spark, d).join(_files(spark, d).select(*KEY, F.col("content_hash").alias("file_hash")).distinct(), [*KEY, "file_hash"], "left_semi")
    return I.gaps(current, KEY)


def files_under_directories(spark: SparkSession, d: str) -> DataFrame:
    """Files below every directory of a project."""
    rows = _files(spark, d).select(*KEY).distinct().withColumn("directory", F.explode(ancestors(F.col("path"))))
    return rows.groupBy("project_id", "directory").agg(F.count("*").alias("files"))


def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """For every file the deepest directory that holds at least three files."""
    dirs = files_under_directories(spark, d).where("files >= 3").select("project_id", F.col("directory").alias("prefix"))
    met = I.with_ancestor(_files(spark, d).select(*KEY).distinct(), dirs, ["project_id"])
    return met.groupBy(*KEY).agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def file_filters(spark: SparkSession, d: str) -> DataFrame:
    """Which discovery filters hold for each file."""
    p = F.col("path")
    secret = "|".join(glob_regex(g) for g in SECRET_FILES)
    return _files(spark, d).select(*KEY).distinct().select(
        *KEY, F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, EXCLUDED_DIRS))).alias("excluded"), p.rlike(secret).alias("secret"), basename(p).isin(LOCK_FILES).alias("lock"), F.coalesce(language_of(p), F.lit("other")).alias("by_suffix")
    )


def project_ignores(spark: SparkSession, d: str) -> DataFrame:
    """Files that their project's extra ignore patterns leave out: one expression a project."""
    rule = F.udf(lambda globs: "|".join(f"(?:{glob_regex(g)})" for g in globs), "string")
    rules = table(spark, d, "projects").where("size(extra_ignores) > 0").select(F.col("id").alias("project_id"), rule("extra_ignores").alias("expression"))
    return _files(spark, d).join(rules, "project_id").where(F.expr("path RLIKE expression")).select(*KEY).distinct()


def language_preview(spark: SparkSession, d: str) -> DataFrame:
    """Files and pieces per language, null as other."""
    f = _files(spark, d)
    return f.groupBy(F.coalesce("language", F.lit("other")).alias("language")).agg(F.count("*").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("pieces"))


def supported_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """The suffixes seen for each language that they stand for."""
    f = _files(spark, d).select(language_of(F.col("path")).alias("language"), F.regexp_extract(basename(F.col("path")), r"(\.[^.]+)$", 1).alias("suffix")).where("language IS NOT NULL")
    return f.groupBy("language").agg(F.array_join(F.sort_array(F.collect_set("suffix")), ",").alias("suffixes"))


def chunk_identities(spark: SparkSession, d: str) -> DataFrame:
    """Content-derived ids, snippet and size estimate of every piece."""
    c = _chunks(spark, d)
    name = F.concat_ws(":", "project_id", "path", F.col("start_line").cast("string"), "file_hash")
    return c.select("chunk_id", uuid5(NAMESPACE, name).alias("uuid"), F.sha2("text", 256).alias("text_hash"), snippet(F.col("text")).alias("snippet"), token_estimate(F.col("text")).alias("tokens")).distinct()


def pseudo_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic vectors of symbol names, first value and sum."""
    names = table(spark, d, "chunks").where("symbol_name IS NOT NULL").select("symbol_name").distinct()
    v = names.withColumn("v", pseudo_vector(F.col("symbol_name"), 8))
    return v.select("symbol_name", F.round(F.col("v")[0], 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def points_per_file(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select(*KEY, "chunk_id").distinct().groupBy(*KEY).agg(F.count("*").alias("points"))


_F = f"f AS (SELECT DISTINCT project_id, {SQL_PATH.format('path')} AS path, language, content_hash, chunk_count FROM files)"
_C = f"c AS (SELECT * EXCLUDE (file_path), {SQL_PATH.format('file_path')} AS path FROM chunks)"
_L = f"l AS (SELECT project_id, {SQL_PATH.format('path')} AS path, arg_max(lower(content_hash), coalesce(last_indexed_at, TIMESTAMPTZ '1900-01-01')) AS content_hash FROM file_snapshots WHERE snapshot_no = (SELECT max(snapshot_no) FROM file_snapshots) GROUP BY 1, 2)"
_D = "dr AS (SELECT project_id, path, coalesce(points, 0) AS points, chunk_count FROM (SELECT DISTINCT project_id, path, chunk_count FROM f) LEFT JOIN (SELECT project_id, path, count(DISTINCT chunk_id) AS points FROM c GROUP BY 1, 2) USING (project_id, path) WHERE coalesce(points, 0) <> chunk_count)"
_DIFF = "df AS (SELECT project_id, path, CASE WHEN s IS NULL THEN 'new' WHEN t IS NULL THEN 'deleted' WHEN a IS NOT DISTINCT FROM b THEN 'unchanged' ELSE 'changed' END AS bucket FROM (SELECT project_id, path, content_hash AS a, 1 AS s FROM f) FULL JOIN (SELECT project_id, path, content_hash AS b, 1 AS t FROM l) USING (project_id, path))"
_DIRS = "dirs AS (SELECT project_id, array_to_string(string_split(path, '/')[1:i], '/') AS directory, count(*) AS files FROM (SELECT DISTINCT project_id, path FROM f), range(1, 40) t(i) WHERE i < len(string_split(path, '/')) GROUP BY 1, 2)"

QUERIES = {
    f.__name__: f
    for f in (
        index_hash_diff, index_candidates, index_restricted, index_drift, index_orphans, index_pruned, index_upsert, index_gaps, files_under_directories, longest_prefix, file_filters,
        project_ignores, language_preview, supported_suffixes, chunk_identities, pseudo_vectors, points_per_file,
    )
}
_SUFFIX = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1))"
_BY_SUFFIX = "CASE {s} WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.java' THEN 'java' WHEN '.c' THEN 'c' WHEN '.sh' THEN 'bash' WHEN '.sql' THEN 'sql' WHEN '.json' THEN 'json' WHEN '.yaml' THEN 'yaml' WHEN '.toml' THEN 'toml' WHEN '.md' THEN 'markdown' END".format(s=_SUFFIX)
_NAME = "regexp_extract(path, '[^/]*$')"
_SECRET = " OR ".join(
    [f"{_NAME} IN ('.env', '.netrc', '.npmrc', '.pypirc')", *[f"starts_with({_NAME}, '{x}')" for x in (".env.", "id_rsa", "id_ed25519", "id_ecdsa", "id_dsa", "credentials", "secrets.")]]
    + [f"ends_with({_NAME}, '{x}')" for x in (".pem", ".key", ".p12", ".pfx", ".jks", ".keystore", ".ppk", ".tfvars", ".secret")] + [f"contains('/' || path, '/{x}/')" for x in (".aws", ".ssh")]
)
_SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(name))"
SQL = {
    "index_hash_diff": f"WITH {_F}, {_L}, {_DIFF} SELECT * FROM df",
    "index_candidates": f"WITH {_F}, {_C}, {_L}, {_DIFF}, {_D} SELECT project_id, path FROM df WHERE bucket IN ('new', 'changed') UNION SELECT project_id, path FROM dr UNION SELECT project_id, path FROM c ANTI JOIN f USING (project_id, path)",
    "index_restricted": f"WITH {_F}, {_C}, {_L}, {_D} SELECT project_id, path FROM l WHERE (project_id, path) IN (SELECT (project_id, path) FROM dr) OR (project_id, path) NOT IN (SELECT (project_id, path) FROM f)",
    "index_drift": f"WITH {_F}, {_C}, {_D} SELECT * FROM dr",
    "index_orphans": f"WITH {_F}, {_C} SELECT DISTINCT chunk_id, project_id, path FROM c ANTI JOIN f USING (project_id, path)",
    "index_pruned": f"WITH {_F}, {_C} SELECT project_id, count(*) AS points FROM (SELECT DISTINCT chunk_id, project_id, path, file_hash FROM c) c LEFT JOIN (SELECT DISTINCT project_id, path, content_hash FROM f) f USING (project_id, path) WHERE f.content_hash IS NULL OR f.content_hash = file_hash GROUP BY 1",
    "index_upsert": f"WITH {_F}, {_L} SELECT project_id, count(*) AS files, count(b) AS replaced FROM (SELECT DISTINCT project_id, path FROM f) FULL JOIN (SELECT project_id, path, 1 AS b FROM l) USING (project_id, path) GROUP BY 1",
    "index_gaps": f"WITH {_F}, {_C}, p AS (SELECT DISTINCT project_id, path, chunk_id, start_line, end_line FROM c SEMI JOIN (SELECT project_id, path, content_hash AS file_hash FROM f) USING (project_id, path, file_hash)), s AS (SELECT *, lag(end_line) OVER (PARTITION BY project_id, path ORDER BY start_line) AS e FROM p) SELECT project_id, path, count(*) AS pieces, count(*) FILTER (start_line <> coalesce(e, 0) + 1) AS breaks FROM s GROUP BY 1, 2",
    "files_under_directories": f"WITH {_F}, {_DIRS} SELECT * FROM dirs",
    "longest_prefix": f"WITH {_F}, {_DIRS} SELECT f.project_id, f.path, arg_max(directory, length(directory)) AS prefix FROM (SELECT DISTINCT project_id, path FROM f) f JOIN dirs ON f.project_id = dirs.project_id AND starts_with(f.path, directory || '/') WHERE files >= 3 GROUP BY 1, 2",
    "project_ignores": f"WITH {_F} SELECT DISTINCT f.project_id, f.path FROM f JOIN (SELECT id, unnest(extra_ignores) AS g FROM projects) p ON p.id = f.project_id WHERE ends_with(g, '/**') AND NOT regexp_matches(left(g, len(g) - 3), '[*?]') AND starts_with(f.path, left(g, len(g) - 2))",
    "language_preview": f"WITH {_F} SELECT coalesce(language, 'other') AS language, count(*) AS files, coalesce(sum(chunk_count), 0) AS pieces FROM f GROUP BY 1",
    "supported_suffixes": f"WITH {_F} SELECT {_BY_SUFFIX} AS language, string_agg(DISTINCT {_SUFFIX}, ',' ORDER BY {_SUFFIX}) AS suffixes FROM f GROUP BY 1 HAVING language IS NOT NULL",
    "file_filters": f"WITH {_F} SELECT DISTINCT project_id, path, list_has_any(string_split(path, '/'), {EXCLUDED_DIRS!r}) AS excluded, {_SECRET} AS secret, list_contains({LOCK_FILES!r}, regexp_extract(path, '[^/]*$')) AS lock, coalesce({_BY_SUFFIX}, 'other') AS by_suffix FROM f",
    "chunk_identities": f"WITH {_C}, n AS (SELECT DISTINCT chunk_id, concat_ws(':', project_id, path, start_line, file_hash) AS name, text FROM c), h AS (SELECT *, {_SHA} AS h FROM n) SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8','9','a','b'][(instr('0123456789abcdef', h[17:17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS uuid, sha256(text) AS text_hash, substring(text, 1, 200) AS snippet, CAST(ceil(length(regexp_replace(text, '\\s', '', 'g')) / 4.0) AS BIGINT) AS tokens FROM h",
    "pseudo_vectors": "WITH n AS (SELECT DISTINCT symbol_name, sha256('0:' || symbol_name) AS h FROM chunks WHERE symbol_name IS NOT NULL), b AS (SELECT symbol_name, i, ((instr('0123456789abcdef', h[2*i+1:2*i+1]) - 1) * 16 + instr('0123456789abcdef', h[2*i+2:2*i+2]) - 1) / 255.0::DOUBLE * 2 - 1 AS x FROM n, range(0, 8) t(i)) SELECT symbol_name, round(max(x) FILTER (i = 0), 6) AS first, round(sum(x), 6) AS total FROM b GROUP BY 1",
    "points_per_file": f"WITH {_C} SELECT project_id, path, count(DISTINCT chunk_id) AS points FROM c GROUP BY 1, 2",
}
