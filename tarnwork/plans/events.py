"""Registered queries for file events, with their SQL. The events table stands in: users own paths, kinds are file events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.session import table
from tarnwork.streaming import events as E

KINDS = {"signup": "created", "click": "modified", "view": "modified", "purchase": "moved", "error": "deleted"}


def _shape(rows: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    path = F.concat(F.lit("src/"), F.get_json_object("props", "$.k"), F.lit(".py"))
    raw = rows.select(
        F.col("user_id").alias("owner"), path.alias("path"), F.concat(F.lit("moved/"), path).alias("target"), F.element_at(kind, F.col("event_type")).alias("event"), F.lit(False).alias("is_dir"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq")
    )
    return E.normalised(raw)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _shape(table(spark, d, "events"))


def events_coalesced(spark: SparkSession, d: str) -> DataFrame:
    return E.coalesced(_events(spark, d))


def events_pending(spark: SparkSession, d: str) -> DataFrame:
    return E.pending_after(_events(spark, d), "2024-01-10 00:00:00")


def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.quiet_periods(_events(spark, d), "2 hours")


def events_daily(spark: SparkSession, d: str) -> DataFrame:
    return E.daily_counters(_events(spark, d))


def _live(spark: SparkSession, d: str) -> DataFrame:
    """Owners that exist: customers in credit."""
    return table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("owner"))


def events_live(spark: SparkSession, d: str) -> DataFrame:
    """Pending events of owners that exist, beside excluded paths and one ignore rule."""
    return E.coalesced(E.of_live_owners(E.watched(_events(spark, d), ["*1.py"]), _live(spark, d)))


def events_failed_back(spark: SparkSession, d: str) -> DataFrame:
    """What is pending after a run that failed on the files that were deleted at last."""
    all_ = E.coalesced(_events(spark, d))
    return E.back_to_pending(E.pending_after(_events(spark, d), "2024-01-10 00:00:00"), all_.where("event = 'deleted'"))


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    """The coalesced events as a stateful stream over the table's files works them out."""
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    return E.drain(E.coalesced(_shape(stream)), ["owner", "path"], "seen")


_E = """WITH b AS (SELECT user_id AS owner, 'src/' || json_extract_string(props, '$.k') || '.py' AS path, ts AS "at", event_id AS seq, event_type AS k FROM events),
e AS (SELECT owner, path, "at", seq, CASE k WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'deleted' ELSE 'modified' END AS event FROM b
  UNION ALL SELECT owner, 'moved/' || path, "at", seq, 'created' FROM b WHERE k = 'purchase'),
g AS (SELECT owner, path, arg_max(event, ("at", seq)) AS l, arg_max(event, ("at", seq)) FILTER (event <> 'modified') AS base, max("at") AS "at", count(*) AS seen FROM e GROUP BY 1, 2),
co AS (SELECT owner, path, CASE WHEN l = 'modified' AND base = 'created' THEN 'created' ELSE l END AS event, "at", seen FROM g)
"""
QUERIES = {f.__name__: f for f in (events_coalesced, events_pending, events_sessions, events_daily, events_live, events_failed_back, events_stream)}
SQL = {
    "events_coalesced": _E + "SELECT * FROM co",
    "events_stream": _E + "SELECT * FROM co",
    "events_live": _E + "SELECT co.* FROM co JOIN customer ON c_custkey = owner WHERE c_acctbal >= 0 AND NOT ends_with(path, '1.py')",
    "events_failed_back": _E + "SELECT owner, path, CASE WHEN \"at\" > TIMESTAMP '2024-01-10' THEN event ELSE 'modified' END AS event, \"at\" FROM co WHERE \"at\" > TIMESTAMP '2024-01-10' OR event = 'deleted'",
    "events_pending": _E + "SELECT * FROM co WHERE \"at\" > TIMESTAMP '2024-01-10'",
    "events_sessions": _E + """, s AS (SELECT *, CASE WHEN "at" - lag("at") OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM e WINDOW w AS (PARTITION BY owner ORDER BY "at", seq, path)), i AS (SELECT *, sum(n) OVER (PARTITION BY owner ORDER BY "at", seq, path ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT owner, min("at") AS first, max("at") AS last, count(*) AS events FROM i GROUP BY owner, k""",
    "events_daily": _E + "SELECT owner, CAST(\"at\" AS DATE) AS day, count(*) AS seen, count(*) - count(DISTINCT path) AS coalesced FROM e GROUP BY 1, 2",
}
