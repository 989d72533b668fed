"""File events: normalising, coalescing and quiet periods, on streams and on tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.functions.globs import EXCLUDED_DIRS, LOCK_FILES, SECRET_FILES, compile_rules, glob_regex
from tarnwork.session import shared_folder

#: Endings and beginnings of the files that editors write beside the real ones.
NOISE = r"(?:\.swp|\.swo|\.swx|~|\.tmp|\.part|\.crswap)$|(?:^|/)(?:\.#|#)[^/]*$|(?:^|/)4913$"


def normalised(raw: DataFrame) -> DataFrame:
    """owner, path, event, at, seq: a move becomes a deletion and a creation, other kinds pass only if they change a file.

    `raw` needs owner, path, target, event, is_dir, at, seq. Directory events count only when
    deleted; noise of editors is left out.
    """
    ev = lambda path, what: F.struct(path.alias("path"), what.alias("event"))
    out = F.when(F.col("event") == "moved", F.array(ev(F.col("path"), F.lit("deleted")), ev(F.col("target"), F.lit("created")))).otherwise(F.array(ev(F.col("path"), F.col("event"))))
    rows = raw.withColumn("_e", F.explode(out)).select("owner", F.col("_e.path").alias("path"), F.col("_e.event").alias("event"), "is_dir", "at", "seq")
    kept = rows.where(F.col("event").isin("created", "modified", "deleted") & (~F.col("is_dir") | (F.col("event") == "deleted")))
    return kept.where(F.col("path").isNotNull() & ~F.col("path").rlike(NOISE)).drop("is_dir")


def coalesced(events: DataFrame) -> DataFrame:
    """One pending event per owner and path: the last one, but created stays created under later modifications.

    Aggregates only: the last event, and the last that isn't a modification. On a stream, in
    update mode, each batch gives the new row of every path that it touched.
    """
    at = F.struct("at", "seq")
    got = events.groupBy("owner", "path").agg(F.max_by("event", at).alias("_last"), F.max_by(F.when(F.col("event") != "modified", F.col("event")), F.when(F.col("event") != "modified", at)).alias("_base"), F.max("at").alias("at"), F.count("*").alias("seen"))
    kind = F.when((F.col("_last") == "modified") & (F.col("_base") == "created"), "created").otherwise(F.col("_last"))
    return got.select("owner", "path", kind.alias("event"), "at", "seen")


def pending_after(events: DataFrame, cut_at: str) -> DataFrame:
    """What stays pending after a run that was launched at the cut: paths with an event after it."""
    return coalesced(events).where(F.col("at") > F.lit(cut_at).cast("timestamp"))


def watched(events: DataFrame, ignores: list[str] | None = None) -> DataFrame:
    """Events of paths that discovery would read: not below an excluded directory, no secret or lock file, nothing that the ignore lines leave out. Works on streams."""
    p = F.col("path")
    out = F.arrays_overlap(F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(1))), F.array(*map(F.lit, EXCLUDED_DIRS))) & p.contains("/")
    kept = events.where(~out & ~p.rlike("|".join(map(glob_regex, SECRET_FILES))) & ~F.element_at(F.split(p, "/"), -1).isin(LOCK_FILES))
    verdict = F.lit(False)
    for pattern, hides in compile_rules(ignores or []):
        verdict = F.when(p.rlike(pattern.pattern), F.lit(hides)).otherwise(verdict)
    return kept.where(~verdict)


def of_live_owners(events: DataFrame, live: DataFrame, owner: str = "owner") -> DataFrame:
    """Events whose owner still exists; those of a removed one are dropped, the others flow on."""
    return events.join(live.select(owner).distinct(), owner, "left_semi")


def back_to_pending(pending: DataFrame, failed: DataFrame) -> DataFrame:
    """pending with the paths that a run failed on, as modified; one that is pending already keeps its event. `failed` has owner, path, at."""
    new = failed.groupBy("owner", "path").agg(F.max("at").alias("at")).join(pending.select("owner", "path"), ["owner", "path"], "left_anti")
    return pending.select("owner", "path", "event", "at").unionByName(new.select("owner", "path", F.lit("modified").alias("event"), "at"))


def quiet_periods(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of an owner's events that end after `gap` without one: start, end of the last event, events."""
    s = events.groupBy("owner", F.session_window("at", gap).alias("w")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("events"))
    return s.select("owner", "first", "last", "events")


def daily_counters(events: DataFrame) -> DataFrame:
    """Events seen per owner and day, and how many of them coalesced away."""
    per = events.groupBy("owner", F.to_date("at").alias("day"), "path").agg(F.count("*").alias("n"))
    return per.groupBy("owner", "day").agg(F.sum("n").alias("seen"), F.greatest(F.sum("n") - F.count("*"), F.lit(0)).alias("coalesced"))


def drain(stream: DataFrame, key: list[str], seen: str) -> DataFrame:
    """Runs an update stream over all that is there and gives its last row per key.

    Each batch is written to the shared folder the session names; nothing passes the driver.
    """
    spark: SparkSession = stream.sparkSession
    base = shared_folder(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    written: list[int] = []

    def save(batch: DataFrame, n: int) -> None:
        written.append(n)
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [f.name for f in schema if f.name not in key]
    if not written:  # the source was empty
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(f"{base}/out")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_batch", seen)).alias("_r")).select(*key, "_r.*")


def rank_in_order(events: DataFrame) -> DataFrame:
    """Seconds since an owner's previous event, null for the first."""
    order = Window.partitionBy("owner").orderBy("at", "seq")
    gap = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(order).cast("timestamp"))) / 1e6
    return events.select("owner", "seq", gap.alias("gap"))
