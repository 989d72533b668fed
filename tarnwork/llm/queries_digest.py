"""Queries of the percentile operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.digest import certify, estimates, measurements, merge_digests, partial_digests, rank_bound
from tarnwork.session import cut, table

QS = [0.5, 0.9, 0.95, 0.99]


def _log(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "query_log").select("id", "interface", "kind", F.to_date("ts").alias("day"), F.col("latency_ms").alias("x"))
    return measurements(log, "id", "x", ["interface", "kind", "day"])


def p2_day_digests(spark: SparkSession, d: str) -> DataFrame:
    """The stored partial results: centroids per interface, kind and day."""
    group = ["interface", "kind", "day"]
    return merge_digests(partial_digests(_log(spark, d), group, "x"), group)


def p2_certified_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per day, week and over all days, with the stated bound and the rank error that a second count certifies.

    Weeks and the whole come from the stored day digests alone. Rows with a null ts form a day
    of their own; a week is named by its Monday.
    """
    group = ["interface", "kind", "day"]
    rows = cut(_log(spark, d))
    days = cut(merge_digests(partial_digests(rows, group, "x"), group))
    scoped = days.withColumn("s", F.explode(_scopes())).select("interface", "kind", F.col("s.scope").alias("scope"), F.col("s.start").alias("start"), "mean", "weight")
    key = ["interface", "kind", "scope", "start"]
    single, union = scoped.where("scope = 'day'"), scoped.where("scope <> 'day'")
    est = cut(estimates(single.unionByName(merge_digests(union, key, salted=False)), key, QS))
    ks = [F.coalesce(c, F.lit("")) for c in ("interface", "kind")]
    day = F.coalesce("day", F.lit("0001-01-01").cast("date"))
    mine = rows.select(*[k.alias(n) for k, n in zip(ks, ("interface", "kind"))], day.alias("day"), "x")
    by_day = (
        days.select("interface", "kind", "day").distinct().withColumn("s", F.explode(_scopes()))
        .select("interface", "kind", "day", F.col("s.scope").alias("scope"), F.col("s.start").alias("start"))
    )
    a, b = by_day.alias("a"), est.alias("b")
    per_day = (
        a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key])
        .groupBy("a.interface", "a.kind", "a.day")
        .agg(F.sort_array(F.collect_list(F.struct("a.scope", "b.est"))).alias("e"))
        .select(F.coalesce("interface", F.lit("")).alias("interface"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("day", F.lit("0001-01-01").cast("date")).alias("day"), F.flatten(F.transform("e", lambda e: e["est"])).alias("est"))
    )
    per_day = cut(per_day)
    counted = certify(mine, group, "x", per_day, QS * 3, per_day.count())
    n = len(QS)
    slices = [
        F.struct(F.lit(s).alias("scope"), start.alias("start"), F.slice("below", 1 + n * i, n).alias("below"), F.slice("upto", 1 + n * i, n).alias("upto"))
        for i, (s, start) in enumerate((("all", F.lit(None).cast("date")), ("day", F.col("d")), ("week", F.to_date(F.date_trunc("week", "d")))))
    ]
    ranks = (
        counted.withColumn("d", F.when(F.col("day") > F.lit("0001-01-01").cast("date"), F.col("day")))
        .withColumn("s", F.explode(F.array(*slices)))
        .groupBy("interface", "kind", F.col("s.scope").alias("scope"), F.col("s.start").alias("start"))
        .agg(*[c for i in range(n) for c in (F.sum(F.col("s.below")[i]).alias(f"b{i}"), F.sum(F.col("s.upto")[i]).alias(f"u{i}"))])
    )
    r, e = ranks.alias("r"), est.alias("e")
    on = [F.col("r.interface") == F.coalesce("e.interface", F.lit("")), F.col("r.kind") == F.coalesce("e.kind", F.lit("")), F.col("r.scope") == F.col("e.scope"), F.col("r.start").eqNullSafe(F.col("e.start"))]
    met = e.join(r, on)
    q = F.explode(F.array(*[F.struct(F.lit(x).alias("q"), F.col("e.est")[i].alias("estimate"), F.col(f"r.b{i}").alias("below"), F.col(f"r.u{i}").alias("upto"), F.when(F.col("e.scope") == "day", rank_bound(x)).otherwise(rank_bound(x, clusterings=4)).alias("bound")) for i, x in enumerate(QS)]))
    out = met.select("e.scope", "e.start", "e.interface", "e.kind", "e.n", q.alias("z")).select("scope", "start", "interface", "kind", "n", "z.*")
    at = F.col("q") * F.col("n")
    bound = F.col("bound") + 1.0 / F.col("n")
    error = F.greatest(F.col("below") - at, at - F.col("upto"), F.lit(0.0)) / F.col("n")
    return out.select("scope", "start", "interface", "kind", "n", "q", "estimate", error.alias("rank_error"), bound.alias("bound"), (error <= bound).alias("certified"))


def _scopes():
    s = lambda name, start: F.struct(F.lit(name).alias("scope"), start.alias("start"))
    return F.array(s("all", F.lit(None).cast("date")), s("day", F.col("day")), s("week", F.to_date(F.date_trunc("week", "day"))))


def p2_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Counts and the certificate alone, which SQL can state exactly."""
    return p2_certified_percentiles(spark, d).select("scope", "start", "interface", "kind", "q", "n", "certified")


QUERIES = {"p2_certified_percentiles": p2_certified_percentiles, "p2_within_bound": p2_within_bound, "p2_day_digests": p2_day_digests}
SQL = {
    "p2_within_bound": """
WITH m AS (SELECT DISTINCT ON (id) interface, kind, CAST(ts AT TIME ZONE 'UTC' AS DATE) AS day FROM query_log WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms)),
s AS (SELECT 'day' AS scope, day AS start, interface, kind FROM m
  UNION ALL SELECT 'week', CAST(date_trunc('week', day) AS DATE), interface, kind FROM m
  UNION ALL SELECT 'all', NULL, interface, kind FROM m)
SELECT scope, start, interface, kind, q, count(*) AS n, TRUE AS certified
FROM s CROSS JOIN (VALUES (0.5::DOUBLE), (0.9), (0.95), (0.99)) AS v(q) GROUP BY ALL
""",
}
