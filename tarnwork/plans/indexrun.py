"""Registered queries for what an index run decides, with their SQL.

Stand-ins from the given tables: a project's dirty paths are the paths that failed, their
directories those that weren't walked, and the directory of its extra ignores is unscreened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.paths import canonical_path
from tarnwork.operators import indexing as I
from tarnwork.operators import indexrun as X
from tarnwork.operators import runs as R
from tarnwork.plans.general import SQL_PATH
from tarnwork.plans.indexing import _C, _D, _DIFF, _F, _L, KEY, _chunks, _files, _last_snapshot, index_hash_diff
from tarnwork.plans.usage import _R, _runs
from tarnwork.session import table

HOUR = 3600.0


def _failed(spark: SparkSession, d: str) -> DataFrame:
    dirty = table(spark, d, "projects").select(F.col("id").alias("project_id"), F.explode("dirty_paths").alias("path"))
    return dirty.select("project_id", canonical_path(F.col("path")).alias("path"))


def _unwalked(spark: SparkSession, d: str) -> DataFrame:
    return _failed(spark, d).select("project_id", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("prefix")).where("prefix <> ''").distinct()


def _unscreened(spark: SparkSession, d: str) -> DataFrame:
    globs = table(spark, d, "projects").select(F.col("id").alias("project_id"), F.explode("extra_ignores").alias("glob"))
    return globs.select("project_id", F.regexp_extract("glob", r"^([^*?\[]+)/\*\*$", 1).alias("prefix")).where("prefix <> ''").distinct()


def run_orphan_points(spark: SparkSession, d: str) -> DataFrame:
    points = _chunks(spark, d).select("chunk_id", *KEY).distinct()
    return X.orphan_points(points, _files(spark, d), _last_snapshot(spark, d), _failed(spark, d), _unwalked(spark, d)).select("chunk_id", *KEY)


def run_readmitted(spark: SparkSession, d: str) -> DataFrame:
    return X.readmitted(_last_snapshot(spark, d), _files(spark, d), _unwalked(spark, d))


def _deletions(spark: SparkSession, d: str) -> DataFrame:
    return X.deletions(index_hash_diff(spark, d).where("bucket = 'deleted'"), _unwalked(spark, d), _unscreened(spark, d))


def run_deletions(spark: SparkSession, d: str) -> DataFrame:
    """Missing files: provable deletions, or held back."""
    return _deletions(spark, d)


def run_pending_again(spark: SparkSession, d: str) -> DataFrame:
    """Changed files that stay pending beside quarantined directories."""
    changed = index_hash_diff(spark, d).where("bucket IN ('new', 'changed')").select(*KEY)
    return X.pending_again(changed, _unscreened(spark, d))


def run_embed_again(spark: SparkSession, d: str) -> DataFrame:
    drifted = I.drift(_files(spark, d), _chunks(spark, d), KEY)
    return X.to_embed_again(drifted, _last_snapshot(spark, d), index_hash_diff(spark, d).where("bucket IN ('new', 'changed')"))


def _open(spark: SparkSession, d: str) -> DataFrame:
    return X.unresolved(_failed(spark, d), _deletions(spark, d).where("verdict <> 'provable'"))


def run_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d)


def run_errors(spark: SparkSession, d: str) -> DataFrame:
    """A row per open path with the kind of its error."""
    held = _deletions(spark, d)
    return X.error_records(failed=_failed(spark, d), screening_held=held.where("verdict = 'screening_held'"), unverified=held.where("verdict = 'unverified'"))


def run_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Counters and verdicts of a run over every project."""
    written = _chunks(spark, d).select(*KEY, "chunk_id").distinct().groupBy(*KEY).agg(F.count("*").alias("chunks"))
    return X.run_verdicts(X.run_counters(index_hash_diff(spark, d), _failed(spark, d), written), _open(spark, d))


def index_status(spark: SparkSession, d: str) -> DataFrame:
    """Expected and stored pieces; drift counts only if the expected number held still between the list and the last delivery."""
    files = _files(spark, d)
    expected = files.groupBy("project_id").agg(F.sum("chunk_count").alias("expected"))
    again = files.join(_last_snapshot(spark, d).select(*KEY), KEY, "left_semi").groupBy("project_id").agg(F.sum("chunk_count").alias("expected"))
    points = _chunks(spark, d).select("project_id", "chunk_id").distinct().groupBy("project_id").agg(F.count("*").alias("points"))
    return X.status(expected, again, points)


def project_overview(spark: SparkSession, d: str) -> DataFrame:
    """Every project by name with its pending paths, newest indexing and the seconds it was behind the newest of all."""
    p = table(spark, d, "projects")
    name = F.coalesce(F.nullif(F.element_at(F.split("root_path", "/"), -1), F.lit("")), F.col("root_path"))
    f = table(spark, d, "files").groupBy("project_id").agg(F.max("last_indexed_at").alias("last_indexed"))
    newest = table(spark, d, "files").agg(F.max("last_indexed_at").alias("_now"))
    met = p.select(F.col("id").alias("project_id"), name.alias("name"), F.coalesce(F.size("dirty_paths"), F.lit(0)).alias("_n")).join(f, "project_id", "left").join(F.broadcast(newest))
    age = F.when(F.col("last_indexed").isNotNull(), F.greatest(F.lit(0), F.floor((F.unix_micros("_now") - F.unix_micros("last_indexed")) / 1e6)))
    return met.select("project_id", "name", F.greatest("_n", F.lit(0)).cast("bigint").alias("pending"), "last_indexed", age.cast("double").alias("age_seconds"))


def overview_totals(spark: SparkSession, d: str) -> DataFrame:
    o = project_overview(spark, d)
    return o.agg(F.count("*").alias("projects"), F.sum("pending").alias("pending"), F.count("last_indexed").alias("indexed"), F.max("age_seconds").alias("oldest"))


def dirty_paths(spark: SparkSession, d: str) -> DataFrame:
    """Dirty paths of every project after the changed files came in, as one text."""
    changed = index_hash_diff(spark, d).where("bucket = 'changed'").select(*KEY)
    return X.dirty_union(table(spark, d, "projects"), changed).select("project_id", F.size("dirty_paths").cast("bigint").alias("n"), F.array_join("dirty_paths", "|").alias("paths"))


def pending_cleared(spark: SparkSession, d: str) -> DataFrame:
    """Pending changes after a run over the paths of the last delivery, which was launched at a given time."""
    pending = table(spark, d, "files").select("project_id", canonical_path(F.col("path")).alias("path"), F.col("last_indexed_at").alias("detected_at")).groupBy(*KEY).agg(F.max("detected_at").alias("detected_at"))
    return X.cleared(pending, _last_snapshot(spark, d), F.lit("2025-06-15 00:00:00").cast("timestamp")).select(*KEY)


def project_deleted(spark: SparkSession, d: str) -> DataFrame:
    """What is left per project of files after the projects that nobody watches are deleted."""
    gone = table(spark, d, "projects").where("NOT watch_enabled").select(F.col("id").alias("project_id"))
    return X.without_owner(_files(spark, d), gone).groupBy("project_id").agg(F.count("*").alias("files"))


def language_scope(spark: SparkSession, d: str) -> DataFrame:
    """Files within the languages that their project is limited to; without a language they are outside."""
    p = table(spark, d, "projects").select(F.col("id").alias("project_id"), "index_languages")
    met = _files(spark, d).join(p, "project_id")
    inside = F.col("index_languages").isNull() | (F.size("index_languages") == 0) | F.coalesce(F.array_contains("index_languages", F.col("language")), F.lit(False))
    return met.where(inside).groupBy("project_id").agg(F.count("*").alias("files"))


def points_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The points of each file's first line by their ids, beside an id that is none."""
    chunks = table(spark, d, "chunks").select("chunk_id", "project_id", "start_line", "end_line")
    ids = chunks.where("start_line = 1").select("chunk_id").unionByName(chunks.agg(F.lit("no such id").alias("chunk_id")))
    return X.lookup(chunks, ids)


def runs_closed(spark: SparkSession, d: str) -> DataFrame:
    """Runs with the parts that their close events count; a failed run's event has none."""
    parts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.count("*").alias("parts"))
    runs = _runs(spark, d).withColumn("parts", F.lit(0).cast("bigint"))
    ends = runs.select("seq", "status").join(parts, "seq").select("seq", F.when(F.col("status") != "F", F.col("parts")).alias("parts"))
    done = X.closed(runs, ends, "seq", ["parts"])
    return done.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "F").alias("failed"), F.coalesce(F.sum("parts"), F.lit(0)).alias("parts"))


def runs_health(spark: SparkSession, d: str) -> DataFrame:
    """Per owner the scoped runs, when the last one went through, and the latest run."""
    r = _runs(spark, d)
    per = r.groupBy("owner").agg(F.count_if(F.col("status") == "P").alias("scoped"), F.max(F.when(F.col("status") == "O", F.col("at"))).alias("last_done"))
    last = R.latest(r, "owner", ["at", "seq"]).select("owner", F.col("seq").alias("latest"), F.col("status").alias("latest_status"))
    return per.join(last, "owner")


def runs_promoted(spark: SparkSession, d: str) -> DataFrame:
    """Owners whose next run must be a full one, and why."""
    r = _runs(spark, d)
    since = R.since_last(r, "owner", ["at", "seq"], "status = 'O'")
    end = r.agg(F.max("at").alias("_end"))
    age = r.where("status = 'O'").groupBy("owner").agg(F.max("at").alias("_last")).join(F.broadcast(end)).select("owner", ((F.unix_micros(F.col("_end").cast("timestamp")) - F.unix_micros(F.col("_last").cast("timestamp"))) / 1e6 / HOUR).alias("hours"))
    clean = R.latest(r.where("status <> 'P'"), "owner", ["at", "seq"]).select("owner", (F.col("status") == "O").alias("clean"))
    open_ = r.where("status = 'P'").groupBy("owner").agg(F.count("*").alias("open"))
    return X.promotion(since, age, clean, open_, "owner", runs=8, hours=24 * 900, paths=2).where("reason IS NOT NULL")


_FAILED = f"fl AS (SELECT DISTINCT project_id, {SQL_PATH.format('p')} AS path FROM (SELECT id AS project_id, unnest(dirty_paths) AS p FROM projects))"
_UNW = "un AS (SELECT DISTINCT project_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS prefix FROM fl WHERE contains(path, '/'))"
_UNS = r"us AS (SELECT DISTINCT project_id, regexp_extract(g, '^([^*?\[]+)/\*\*$', 1) AS prefix FROM (SELECT id AS project_id, unnest(extra_ignores) AS g FROM projects) WHERE regexp_matches(g, '^[^*?\[]+/\*\*$'))"
_UNDER = "EXISTS (SELECT 1 FROM {0} z WHERE z.project_id = {1}.project_id AND ({1}.path = z.prefix OR starts_with({1}.path, z.prefix || '/')))"
_DEL = f"de AS (SELECT project_id, path, CASE WHEN {_UNDER.format('us', 'df')} THEN 'screening_held' WHEN {_UNDER.format('un', 'df')} THEN 'unverified' ELSE 'provable' END AS verdict FROM df WHERE bucket = 'deleted')"
_ALL = f"WITH {_F}, {_C}, {_L}, {_DIFF}, {_D}, {_FAILED}, {_UNW}, {_UNS}, {_DEL}"
_OPEN = "op AS (SELECT project_id, path FROM fl UNION SELECT project_id, path FROM de WHERE verdict <> 'provable')"

QUERIES = {
    f.__name__: f
    for f in (
        run_orphan_points, run_readmitted, run_deletions, run_pending_again, run_embed_again, run_unresolved, run_errors, run_verdicts, index_status, project_overview, overview_totals, dirty_paths,
        pending_cleared, project_deleted, language_scope, points_by_id, runs_closed, runs_health, runs_promoted,
    )
}
_OVER = """p AS (SELECT id AS project_id, coalesce(nullif(string_split(root_path, '/')[-1], ''), root_path) AS name, coalesce(len(dirty_paths), 0) AS pending FROM projects),
x AS (SELECT project_id, max(last_indexed_at) AS last_indexed FROM files GROUP BY 1),
o AS (SELECT p.project_id, name, pending, last_indexed, CAST(floor((epoch_us((SELECT max(last_indexed_at) FROM files)) - epoch_us(last_indexed)) / 1e6::DOUBLE) AS DOUBLE) AS age_seconds FROM p LEFT JOIN x USING (project_id))"""
SQL = {
    "run_orphan_points": f"{_ALL} SELECT DISTINCT chunk_id, project_id, path FROM c WHERE (project_id, path) NOT IN (SELECT (project_id, path) FROM f) AND (project_id, path) NOT IN (SELECT (project_id, path) FROM l) AND (project_id, path) NOT IN (SELECT (project_id, path) FROM fl) AND NOT {_UNDER.format('un', 'c')}",
    "run_readmitted": f"{_ALL} SELECT project_id, path FROM l ANTI JOIN f USING (project_id, path) WHERE {_UNDER.format('un', 'l')}",
    "run_deletions": f"{_ALL} SELECT * FROM de",
    "run_pending_again": f"{_ALL} SELECT project_id, path FROM df WHERE bucket IN ('new', 'changed') AND NOT {_UNDER.format('us', 'df')}",
    "run_embed_again": f"{_ALL} SELECT DISTINCT project_id, path FROM dr SEMI JOIN l USING (project_id, path) ANTI JOIN (SELECT * FROM df WHERE bucket IN ('new', 'changed')) q USING (project_id, path)",
    "run_unresolved": f"{_ALL}, {_OPEN} SELECT * FROM op",
    "run_errors": f"{_ALL} SELECT project_id, path, min(e) AS error FROM (SELECT project_id, path, 'failed' AS e FROM fl UNION ALL SELECT project_id, path, verdict FROM de WHERE verdict <> 'provable') GROUP BY 1, 2",
    "run_verdicts": f"""{_ALL}, {_OPEN}, k AS (SELECT project_id, count(*) FILTER (bucket <> 'deleted') AS files_total, count(*) FILTER (bucket = 'unchanged') AS verified, count(*) FILTER (bucket = 'changed') AS changed, count(*) FILTER (bucket = 'new') AS new, count(*) FILTER (bucket = 'deleted') AS deleted FROM df GROUP BY 1),
e AS (SELECT project_id, count(*) AS failed FROM fl GROUP BY 1), w AS (SELECT project_id, count(DISTINCT (path, chunk_id)) AS chunks_written FROM c SEMI JOIN (SELECT * FROM df WHERE bucket IN ('new', 'changed')) q USING (project_id, path) GROUP BY 1), u AS (SELECT project_id, count(*) AS unresolved FROM op GROUP BY 1),
g AS (SELECT project_id, coalesce(files_total, 0) AS files_total, coalesce(verified, 0) AS verified, coalesce(changed, 0) AS changed, coalesce(new, 0) AS new, coalesce(deleted, 0) AS deleted, coalesce(failed, 0) AS failed, coalesce(chunks_written, 0) AS chunks_written, coalesce(unresolved, 0) AS unresolved
  FROM k FULL JOIN e USING (project_id) LEFT JOIN w USING (project_id) LEFT JOIN u USING (project_id))
SELECT *, changed + new + failed AS candidates, changed + new > 0 AND chunks_written = 0 AS all_failed, failed = 0 AND unresolved = 0 AND NOT (changed + new > 0 AND chunks_written = 0) AS clean, NOT (changed + new > 0 AND chunks_written = 0) AS may_advance FROM g""",
    "index_status": f"{_ALL}, a AS (SELECT project_id, sum(chunk_count) AS expected FROM f GROUP BY 1), b AS (SELECT project_id, sum(chunk_count) AS again FROM f SEMI JOIN l USING (project_id, path) GROUP BY 1), n AS (SELECT project_id, count(DISTINCT chunk_id) AS points FROM c GROUP BY 1) SELECT project_id, coalesce(expected, 0) AS expected, coalesce(points, 0) AS points, CASE WHEN coalesce(expected, 0) = coalesce(again, 0) THEN coalesce(points, 0) <> coalesce(expected, 0) END AS drifted FROM a FULL JOIN b USING (project_id) LEFT JOIN n USING (project_id)",
    "project_overview": f"WITH {_OVER} SELECT * FROM o",
    "overview_totals": f"WITH {_OVER} SELECT count(*) AS projects, sum(pending) AS pending, count(last_indexed) AS indexed, max(age_seconds) AS oldest FROM o",
    "dirty_paths": f"{_ALL}, u AS (SELECT id AS project_id, unnest(dirty_paths) AS path FROM projects UNION SELECT project_id, path FROM df WHERE bucket = 'changed' AND project_id IN (SELECT id FROM projects)) SELECT p.id AS project_id, count(path) AS n, coalesce(string_agg(path, '|' ORDER BY path COLLATE C), '') AS paths FROM projects p LEFT JOIN u ON u.project_id = p.id GROUP BY 1",
    "pending_cleared": f"WITH {_L}, p AS (SELECT project_id, {SQL_PATH.format('path')} AS path, max(last_indexed_at) AS t FROM files GROUP BY 1, 2) SELECT project_id, path FROM p WHERE NOT (coalesce(t <= TIMESTAMPTZ '2025-06-15 00:00:00+00', FALSE) AND (project_id, path) IN (SELECT (project_id, path) FROM l))",
    "project_deleted": f"WITH {_F} SELECT project_id, count(*) AS files FROM f WHERE project_id NOT IN (SELECT id FROM projects WHERE NOT watch_enabled) GROUP BY 1",
    "language_scope": f"WITH {_F} SELECT project_id, count(*) AS files FROM f JOIN projects p ON p.id = f.project_id WHERE index_languages IS NULL OR len(index_languages) = 0 OR coalesce(list_contains(index_languages, language), FALSE) GROUP BY 1",
    "points_by_id": "WITH i AS (SELECT DISTINCT chunk_id FROM chunks WHERE start_line = 1 UNION SELECT 'no such id') SELECT i.chunk_id, project_id, start_line, end_line FROM i LEFT JOIN (SELECT DISTINCT ON (chunk_id) chunk_id, project_id, start_line, end_line FROM chunks ORDER BY chunk_id, project_id, start_line, end_line) c USING (chunk_id)",
    "runs_closed": f"WITH {_R}, n AS (SELECT l_orderkey AS seq, count(*) AS parts FROM lineitem GROUP BY 1) SELECT CAST(\"at\" AS DATE) AS day, count(*) AS runs, count(*) FILTER (status = 'F') AS failed, coalesce(sum(CASE WHEN status <> 'F' THEN coalesce(parts, 0) ELSE 0 END), 0) AS parts FROM r LEFT JOIN n USING (seq) GROUP BY 1",
    "runs_health": f"WITH {_R} SELECT owner, count(*) FILTER (status = 'P') AS scoped, max(\"at\") FILTER (status = 'O') AS last_done, arg_max(seq, (\"at\", seq)) AS latest, arg_max(status, (\"at\", seq)) AS latest_status FROM r GROUP BY 1",
    "runs_promoted": f"""WITH {_R}, f AS (SELECT owner, max(("at", seq)) FILTER (status = 'O') AS m, max("at") FILTER (status = 'O') AS t, arg_max(status, ("at", seq)) FILTER (status <> 'P') = 'O' AS clean, count(*) FILTER (status = 'P') AS open FROM r GROUP BY 1),
s AS (SELECT r.owner, count(*) FILTER (m IS NULL OR ("at", seq) > m) AS since FROM r JOIN f USING (owner) GROUP BY 1),
z AS (SELECT owner, CASE WHEN since >= 8 THEN 'runs' WHEN epoch_us((SELECT max("at") FROM r)) - epoch_us(t) >= 24 * 900 * 3600 * 1000000::BIGINT THEN 'age' WHEN clean AND open >= 2 THEN 'paths' END AS reason FROM f JOIN s USING (owner)) SELECT * FROM z WHERE reason IS NOT NULL""",
}
