"""What an index run decides: which absences are deletions, what to read again, what to report, and whether to move on.

Prefixes are directories that a run could not see. Rows below a prefix are found by an
equi-join on the directories above each path, never by comparing every path with every prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.paths import ancestors

KEY = ["project_id", "path"]


def attributable(prefix: Column) -> Column:
    """Whether an error names a directory of the project: not empty, not the root itself, not absolute, not outside; null is false."""
    return F.coalesce((prefix != "") & (prefix != "<root>") & ~F.startswith(prefix, F.lit("/")) & (prefix != "..") & ~F.startswith(prefix, F.lit("../")), F.lit(False))


def covered(rows: DataFrame, prefixes: DataFrame, mark: str, by: str = "project_id", path: str = "path", prefix: str = "prefix") -> DataFrame:
    """rows with a boolean column `mark`: the path is one of its owner's prefixes or lies below one.

    A prefix that is not attributable hides everything of its owner.
    """
    clean = prefixes.select(by, F.when(attributable(F.col(prefix)), F.col(prefix)).otherwise(F.lit("")).alias("_p")).distinct()
    above = F.array_distinct(F.concat(F.array(F.lit("")), ancestors(F.col(path)), F.array(path)))
    met = rows.select(by, path).distinct().withColumn("_p", F.explode(above)).join(clean, [by, "_p"], "left_semi").select(by, path).distinct().withColumn(mark, F.lit(True))
    return rows.join(met, [by, path], "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def orphan_points(points: DataFrame, files: DataFrame, found: DataFrame, failed: DataFrame, unseen: DataFrame) -> DataFrame:
    """Points whose file is neither stored nor discovered nor failed, and not below a prefix that the run could not see."""
    left = points
    for known in (files, found, failed):
        left = left.join(known.select(*KEY).distinct(), KEY, "left_anti")
    return covered(left, unseen, "_hidden").where("NOT _hidden").drop("_hidden")


def readmitted(found: DataFrame, stored: DataFrame, recovered: DataFrame) -> DataFrame:
    """Discovered files that aren't stored and lie below a prefix that can be seen again."""
    fresh = found.select(*KEY).distinct().join(stored.select(*KEY).distinct(), KEY, "left_anti")
    return covered(fresh, recovered, "_back").where("_back").drop("_back")


def deletions(gone: DataFrame, unwalked: DataFrame, unscreened: DataFrame) -> DataFrame:
    """gone with `verdict`: screening_held below a prefix whose filters couldn't be read, unverified below one that wasn't walked, else provable."""
    met = covered(covered(gone.select(*KEY).distinct(), unwalked, "_u"), unscreened, "_s")
    return met.select(*KEY, F.when(F.col("_s"), "screening_held").when(F.col("_u"), "unverified").otherwise("provable").alias("verdict"))


def pending_again(pending: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Pending paths that stay pending: those not below a quarantined prefix."""
    return covered(pending, quarantined, "_q").where("NOT _q").drop("_q")


def to_embed_again(drifted: DataFrame, hashed: DataFrame, listed: DataFrame) -> DataFrame:
    """Drifted files that were hashed in this run and aren't on the list already."""
    return drifted.select(*KEY).distinct().join(hashed.select(*KEY).distinct(), KEY, "left_semi").join(listed.select(*KEY).distinct(), KEY, "left_anti")


def unresolved(*sets: DataFrame) -> DataFrame:
    """The union of what a run leaves open, each path once."""
    out = sets[0].select(*KEY)
    for s in sets[1:]:
        out = out.unionByName(s.select(*KEY))
    return out.distinct()


def stands_down(reported: DataFrame, quarantined: DataFrame, by: str = "project_id", prefix: str = "prefix") -> DataFrame:
    """Owners all of whose reported prefixes are quarantined, so that their reports no longer hold a run back."""
    met = reported.select(by, prefix).distinct().join(quarantined.select(by, prefix, F.lit(True).alias("_q")).distinct(), [by, prefix], "left")
    return met.groupBy(by).agg(F.bool_and(F.coalesce("_q", F.lit(False))).alias("_all")).where("_all").select(by)


def run_counters(diff: DataFrame, failed: DataFrame, written: DataFrame) -> DataFrame:
    """Per project the counters of a run: files_total, verified, changed, new, deleted, failed, chunks_written, candidates.

    `diff` has project_id, path, bucket; `failed` the paths with an error; `written` the chunks written per path.
    """
    has = lambda b: F.count_if(F.col("bucket") == b)
    d = diff.groupBy("project_id").agg(F.count_if(F.col("bucket") != "deleted").alias("files_total"), has("unchanged").alias("verified"), has("changed").alias("changed"), has("new").alias("new"), has("deleted").alias("deleted"))
    e = failed.select(*KEY).distinct().groupBy("project_id").agg(F.count("*").alias("failed"))
    todo = diff.where(F.col("bucket").isin("new", "changed")).select(*KEY)
    w = written.join(todo, KEY, "left_semi").groupBy("project_id").agg(F.sum("chunks").alias("chunks_written"))
    out = d.join(e, "project_id", "full").join(w, "project_id", "left").fillna(0)
    return out.withColumn("candidates", F.col("changed") + F.col("new") + F.col("failed"))


def run_verdicts(counters: DataFrame, open_paths: DataFrame) -> DataFrame:
    """counters with `unresolved`, `all_failed` (work to do, nothing written), `clean` (nothing failed or open) and `may_advance` (clean, or open paths that are carried on)."""
    n = open_paths.select(*KEY).distinct().groupBy("project_id").agg(F.count("*").alias("unresolved"))
    met = counters.join(n, "project_id", "left").fillna(0, ["unresolved"])
    all_failed = (F.col("changed") + F.col("new") > 0) & (F.col("chunks_written") == 0)
    clean = (F.col("failed") == 0) & (F.col("unresolved") == 0) & ~all_failed
    return met.withColumns({"all_failed": all_failed, "clean": clean, "may_advance": ~all_failed})


def error_records(**sets: DataFrame) -> DataFrame:
    """project_id, path, error of one run: a set per kind of error; of several for one path the first by kind."""
    out = None
    for kind, paths in sets.items():
        part = paths.select(*KEY, F.lit(kind).alias("error"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*KEY).agg(F.min("error").alias("error"))


def status(expected: DataFrame, again: DataFrame, points: DataFrame) -> DataFrame:
    """project_id, expected, points, drifted: whether stored and expected pieces differ, null while the expected number doesn't hold still between two counts."""
    met = expected.select("project_id", F.col("expected")).join(again.select("project_id", F.col("expected").alias("_again")), "project_id", "full").join(points.select("project_id", "points"), "project_id", "left").fillna(0, ["expected", "_again", "points"])
    return met.select("project_id", "expected", "points", F.when(F.col("expected") == F.col("_again"), F.col("points") != F.col("expected")).alias("drifted"))


def promotion(runs_since_full: DataFrame, hours_since_full: DataFrame, last_full_clean: DataFrame, open_paths: DataFrame, owner: str, runs: int, hours: float, paths: int) -> DataFrame:
    """owner, reason why its next run must be a full one, null if none: too many scoped runs, too long ago, or too many open paths after a clean full run. A limit of 0 switches a trigger off."""
    met = runs_since_full.join(hours_since_full, owner, "left").join(last_full_clean, owner, "left").join(open_paths, owner, "left")
    reason = (
        F.when(F.lit(runs > 0) & (F.col("since") >= runs), "runs").when(F.lit(hours > 0) & (F.col("hours") >= hours), "age")
        .when(F.lit(paths > 0) & F.coalesce("clean", F.lit(False)) & (F.coalesce("open", F.lit(0)) >= paths), "paths")
    )
    return met.select(owner, reason.alias("reason"))


def progress(done: Column, total: Column, elapsed: Column) -> dict[str, Column]:
    """percent (one decimal) and eta, the time left at the present pace; null where nothing is done yet."""
    share = F.when((total > 0) & (done > 0), done / total)
    return {"percent": F.bround(share * 100, 1), "eta": F.bround(elapsed / done * (total - done), 1)}


def cleared(pending: DataFrame, paths: DataFrame | None = None, before: Column | None = None) -> DataFrame:
    """Pending rows that a run leaves: all but those on the list of paths (all paths without one) that were detected no later than `before` (at any time without it)."""
    gone = F.lit(True) if before is None else F.coalesce(F.col("detected_at") <= before, F.lit(False))
    if paths is None:
        return pending.where(~gone)
    met = pending.join(paths.select(*KEY, F.lit(True).alias("_l")).distinct(), KEY, "left")
    return met.where(~(gone & F.coalesce("_l", F.lit(False)))).drop("_l")


def closed(runs: DataFrame, ends: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """runs with the counters of their close event where it has them; a null leaves what was there, a run without an event stays as it is."""
    met = runs.join(ends.select(key, *[F.col(c).alias(f"_{c}") for c in counters]), key, "left")
    return met.withColumns({c: F.coalesce(f"_{c}", c) for c in counters}).drop(*[f"_{c}" for c in counters])


def dirty_union(projects: DataFrame, changed: DataFrame) -> DataFrame:
    """project_id and its dirty paths after the changed ones came in: sorted, each once."""
    more = changed.groupBy("project_id").agg(F.collect_set("path").alias("_more"))
    none = F.array().cast("array<string>")
    met = projects.select(F.col("id").alias("project_id"), "dirty_paths").join(more, "project_id", "left")
    return met.select("project_id", F.array_sort(F.array_union(F.coalesce("dirty_paths", none), F.coalesce("_more", none))).alias("dirty_paths"))


def registered(projects: DataFrame, new: DataFrame, model: str = "embedding_model") -> DataFrame:
    """projects with those of `new` whose root isn't known yet, and `refused` for known roots that come with another model."""
    known = projects.select("root_path", F.col(model).alias("_model"))
    met = new.join(known, "root_path", "left")
    fresh = met.where("_model IS NULL").select(*new.columns, F.lit(False).alias("refused"))
    return projects.select(*new.columns, F.lit(False).alias("refused")).unionByName(fresh).unionByName(met.where(F.col("_model") != F.col(model)).select(*new.columns, F.lit(True).alias("refused")))


def without_owner(rows: DataFrame, gone: DataFrame, owner: str = "project_id") -> DataFrame:
    """The rows whose owner isn't deleted; rows without an owner stay."""
    return rows.join(gone.select(owner).distinct(), owner, "left_anti")


def lookup(points: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Each id asked for with its point, once, nulls for an id that is unknown or malformed."""
    one = Window.partitionBy(key).orderBy(*[c for c, t in points.dtypes if c != key and not t.startswith("map")])
    asked = ids.select(key).distinct()
    met = points.join(asked, key, "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    return asked.join(met, key, "left")


def guard_vectors(points: DataFrame, dimension: int, vector: str = "dense") -> DataFrame:
    """Points whose vector has the length that the table was made for; others raise as they are read."""
    fits = F.size(vector) == dimension
    return points.where(F.when(F.col(vector).isNull() | fits, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {dimension} values was expected, not of "), F.size(vector).cast("string"))).cast("boolean")))


def metric_deltas(baseline: DataFrame, challenger: DataFrame, metrics: list[str], by: str = "category") -> DataFrame:
    """Per category each metric of both and the challenger's gain; a category that one side lacks has nulls."""
    b = baseline.select(by, *[F.col(m).alias(f"{m}_base") for m in metrics])
    c = challenger.select(by, *[F.col(m).alias(f"{m}_new") for m in metrics])
    return b.join(c, by, "full").withColumns({f"{m}_gain": F.round(F.col(f"{m}_new") - F.col(f"{m}_base"), 6) for m in metrics})
