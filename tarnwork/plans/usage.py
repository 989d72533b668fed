"""Registered queries for usage reports and run logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators import runs as R
from tarnwork.operators import usage as U
from tarnwork.operators.quantiles import exact_at, index_position, nearest_rank
from tarnwork.session import table

DAYS = ["queries", "searches", "structural", "rest", "mcp", "reranked"]


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Every id once; where copies differ, the least row by its columns in order."""
    log = table(spark, d, "query_log")
    return log.groupBy("id").agg(F.min(F.struct(*[c for c in log.columns if c != "id"])).alias("r")).select("id", "r.*")


def usage_per_day(spark: SparkSession, d: str) -> DataFrame:
    return U.day_spine(U.per_day(_log(spark, d)), DAYS)


def usage_recent(spark: SparkSession, d: str) -> DataFrame:
    """The last 30 days before the newest entry."""
    log = _log(spark, d)
    end = table(spark, d, "query_log").agg(F.to_date(F.max("ts")).alias("_end"))  # copies don't change the newest
    return U.per_day(log.join(F.broadcast(end), F.to_date("ts") >= F.date_sub("_end", 29)))


def usage_channel_mix(spark: SparkSession, d: str) -> DataFrame:
    return U.channel_mix(_log(spark, d))


def usage_latency(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of latency per interface and kind, by index position and by nearest rank."""
    rows = _log(spark, d).where("latency_ms IS NOT NULL AND NOT isnan(latency_ms)")
    return exact_at(rows, ["interface", "kind"], "latency_ms", {"p50": index_position(0.5), "p95": index_position(0.95), "p50_nearest": nearest_rank(0.5), "p95_nearest": nearest_rank(0.95)})


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).agg(F.count("*").alias("queries"), F.count("latency_ms").alias("measured"), F.count_if("reranked").alias("reranked"), F.countDistinct("project_id").alias("projects"), F.sum("result_count").alias("results"))


def index_health(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "chunks").select("project_id", "chunk_id").distinct()
    files = table(spark, d, "files").dropDuplicates(["id", "path"])
    return U.index_health(table(spark, d, "projects"), files, points, _log(spark, d))


def orphan_projects(spark: SparkSession, d: str) -> DataFrame:
    """Projects in the log that no longer exist, with their queries."""
    live = table(spark, d, "projects").select(F.col("id").alias("project_id"))
    gone = _log(spark, d).where("project_id IS NOT NULL").join(live, "project_id", "left_anti")
    return gone.groupBy("project_id").agg(F.count("*").alias("queries"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a log of runs: status F failed, O a full run, P a scoped one."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))


def runs_latest(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(_runs(spark, d), "owner", ["at", "seq"])


def runs_since_full(spark: SparkSession, d: str) -> DataFrame:
    return R.since_last(_runs(spark, d), "owner", ["at", "seq"], "status = 'O'")


def runs_streaks(spark: SparkSession, d: str) -> DataFrame:
    return R.streaks(_runs(spark, d), "owner", ["at", "seq"], "status = 'F'")


def runs_last_full_clean(spark: SparkSession, d: str) -> DataFrame:
    """Whether the last run that wasn't scoped went through."""
    full = _runs(spark, d).where("status <> 'P'")
    return R.latest(full, "owner", ["at", "seq"]).select("owner", "seq", (F.col("status") == "O").alias("clean"))


def runs_per_day(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d)
    return r.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "F").alias("failed"), F.count_if(F.col("status") == "P").alias("scoped"))


def runs_durations(spark: SparkSession, d: str) -> DataFrame:
    """Per status the runs, those with an end, and the mean seconds to their last part."""
    ends = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.max("l_shipdate").alias("end"))
    met = _runs(spark, d).join(ends, "seq", "left")
    seconds = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 1e6
    return met.groupBy("status").agg(F.count("*").alias("runs"), F.count("end").alias("ended"), F.round(F.avg(seconds), 3).alias("mean_seconds"))


def failing_files(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the latest failed run of each owner."""
    last = R.latest(_runs(spark, d).where("status = 'F'"), "owner", ["at", "seq"])
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("part"))
    return last.join(parts, "seq").groupBy("owner", "seq").agg(F.count("*").alias("parts"))


_L = f"l AS (SELECT DISTINCT ON (id) * FROM query_log ORDER BY id, {', '.join(c + ' NULLS FIRST' for c in ('ts', 'interface', 'kind', 'project_id', 'channel', 'reranked', 'latency_ms', 'result_count'))})"
_CNT = "count(*) AS queries, count(*) FILTER (kind = 'search') AS searches, count(*) FILTER (kind = 'structural') AS structural, count(*) FILTER (interface = 'rest') AS rest, count(*) FILTER (interface = 'mcp') AS mcp, count(*) FILTER (reranked) AS reranked"
_DAY = "CAST(ts AT TIME ZONE 'UTC' AS DATE)"
_R = "r AS (SELECT o_custkey AS owner, o_orderdate AS \"at\", o_orderkey AS seq, o_orderstatus AS status FROM orders)"

QUERIES = {
    f.__name__: f
    for f in (usage_per_day, usage_recent, usage_channel_mix, usage_latency, usage_totals, index_health, orphan_projects, runs_latest, runs_since_full, runs_streaks, runs_last_full_clean, runs_per_day, runs_durations, failing_files)
}
SQL = {
    "usage_per_day": f"WITH {_L}, g AS (SELECT {_DAY} AS day, {_CNT} FROM l GROUP BY 1) SELECT CAST(s AS DATE) AS day, coalesce(queries, 0) AS queries, coalesce(searches, 0) AS searches, coalesce(structural, 0) AS structural, coalesce(rest, 0) AS rest, coalesce(mcp, 0) AS mcp, coalesce(reranked, 0) AS reranked FROM (SELECT unnest(generate_series((SELECT min(day) FROM g), (SELECT max(day) FROM g), INTERVAL 1 DAY)) AS s) LEFT JOIN g ON g.day = CAST(s AS DATE)",
    "usage_recent": f"WITH {_L} SELECT {_DAY} AS day, {_CNT} FROM l WHERE {_DAY} >= (SELECT max({_DAY}) FROM l) - 29 GROUP BY 1",
    "usage_channel_mix": f"WITH {_L} SELECT coalesce(channel, 'structural') AS channel, count(*) AS queries FROM l GROUP BY 1",
    "usage_latency": f"""WITH {_L}, m AS (SELECT interface, kind, latency_ms AS x, row_number() OVER w AS r, count(*) OVER (PARTITION BY interface, kind) AS n FROM l WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) WINDOW w AS (PARTITION BY interface, kind ORDER BY latency_ms))
SELECT interface, kind, max(n) AS n, max(x) FILTER (r = round_even(0.5 * (n - 1), 0) + 1) AS p50, max(x) FILTER (r = round_even(0.95::DOUBLE * (n - 1), 0) + 1) AS p95, max(x) FILTER (r = greatest(ceil(0.5 * n), 1)) AS p50_nearest, max(x) FILTER (r = greatest(ceil(0.95::DOUBLE * n), 1)) AS p95_nearest FROM m GROUP BY 1, 2""",
    "usage_totals": f"WITH {_L} SELECT count(*) AS queries, count(latency_ms) AS measured, count(*) FILTER (reranked) AS reranked, count(DISTINCT project_id) AS projects, sum(result_count) AS results FROM l",
    "index_health": f"""WITH {_L} SELECT p.id AS project_id, coalesce(f.files, 0) AS files, coalesce(f.expected, 0) AS expected, coalesce(c.points, 0) AS points, coalesce(q.queries, 0) AS queries, q.last_query FROM projects p
LEFT JOIN (SELECT project_id, count(*) AS files, sum(chunk_count) AS expected FROM (SELECT DISTINCT ON (id, path) * FROM files) GROUP BY 1) f ON f.project_id = p.id LEFT JOIN (SELECT project_id, count(DISTINCT chunk_id) AS points FROM chunks GROUP BY 1) c ON c.project_id = p.id
LEFT JOIN (SELECT project_id, count(*) AS queries, max(ts) AS last_query FROM l GROUP BY 1) q ON q.project_id = p.id""",
    "orphan_projects": f"WITH {_L} SELECT project_id, count(*) AS queries FROM l WHERE project_id IS NOT NULL AND project_id NOT IN (SELECT id FROM projects) GROUP BY 1",
    "runs_latest": f"WITH {_R} SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY owner ORDER BY \"at\" DESC, seq DESC) = 1",
    "runs_since_full": f"WITH {_R}, f AS (SELECT owner, max((\"at\", seq)) FILTER (status = 'O') AS m FROM r GROUP BY 1) SELECT r.owner, count(*) FILTER (m IS NULL OR (\"at\", seq) > m) AS since FROM r JOIN f USING (owner) GROUP BY 1",
    "runs_streaks": f"WITH {_R}, i AS (SELECT owner, status, sum(CASE WHEN status = 'F' THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY \"at\", seq) AS g FROM r), n AS (SELECT owner, g, count(*) FILTER (status = 'F') AS n FROM i GROUP BY 1, 2) SELECT owner, max(n) AS longest, arg_max(n, g) AS current FROM n GROUP BY 1",
    "runs_last_full_clean": f"WITH {_R} SELECT owner, seq, status = 'O' AS clean FROM r WHERE status <> 'P' QUALIFY row_number() OVER (PARTITION BY owner ORDER BY \"at\" DESC, seq DESC) = 1",
    "runs_per_day": f"WITH {_R} SELECT CAST(\"at\" AS DATE) AS day, count(*) AS runs, count(*) FILTER (status = 'F') AS failed, count(*) FILTER (status = 'P') AS scoped FROM r GROUP BY 1",
    "runs_durations": f"WITH {_R}, e AS (SELECT l_orderkey AS seq, max(l_shipdate) AS e FROM lineitem GROUP BY 1) SELECT status, count(*) AS runs, count(e) AS ended, round(avg(epoch_us(e - \"at\") / 1e6::DOUBLE), 3) AS mean_seconds FROM r LEFT JOIN e USING (seq) GROUP BY 1",
    "failing_files": f"WITH {_R}, z AS (SELECT * FROM r WHERE status = 'F' QUALIFY row_number() OVER (PARTITION BY owner ORDER BY \"at\" DESC, seq DESC) = 1) SELECT owner, seq, count(*) AS parts FROM z JOIN lineitem ON l_orderkey = seq GROUP BY 1, 2",
}
