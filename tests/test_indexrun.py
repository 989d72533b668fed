import pytest
from pyspark.sql import functions as F

from tarnwork.functions.globs import compile_rules, ignored
from tarnwork.operators import indexrun as X
from tarnwork.sources import gitstreams
from tarnwork.streaming import events as E
from tests.conftest import rows

KEY = "project_id string, path string"
PRE = "project_id string, prefix string"


def paths(spark, *p, owner="p"):
    return spark.createDataFrame([(owner, x) for x in p], KEY)


def prefixes(spark, *p):
    return spark.createDataFrame([("p", x) for x in p], PRE)


def test_prefixes(spark):
    got = rows(X.covered(paths(spark, "src/a/x", "src", "src2/y", "z"), prefixes(spark, "src", None), "c"), "path", "c")
    assert got == [("src", True), ("src/a/x", True), ("src2/y", True), ("z", True)]  # a prefix that names nothing hides everything
    assert rows(X.covered(paths(spark, "src/a/x", "src", "src2/y"), prefixes(spark, "src"), "c"), "path", "c") == [("src", True), ("src/a/x", True), ("src2/y", False)]
    for odd in ("", "<root>", "/abs", "..", "../up"):
        assert rows(X.covered(paths(spark, "z"), prefixes(spark, odd), "c"), "c") == [(True,)]
    assert X.covered(paths(spark), prefixes(spark, "a"), "c").count() == 0


def test_absences(spark):
    gone = paths(spark, "a/x", "b/x", "c/x", "b/x")
    assert rows(X.deletions(gone, prefixes(spark, "b", "c"), prefixes(spark, "c")), "path", "verdict") == [("a/x", "provable"), ("b/x", "unverified"), ("c/x", "screening_held")]
    points = paths(spark, "stored", "found", "failed", "hid/x", "lost")
    assert rows(X.orphan_points(points, paths(spark, "stored"), paths(spark, "found"), paths(spark, "failed"), prefixes(spark, "hid")), "path") == [("lost",)]
    assert rows(X.readmitted(paths(spark, "s/new", "s/old", "t/new"), paths(spark, "s/old"), prefixes(spark, "s")), "path") == [("s/new",)]
    assert rows(X.stands_down(prefixes(spark, "a", "b"), prefixes(spark, "a", "b", "c"))) == [("p",)] and rows(X.stands_down(prefixes(spark, "a", "d"), prefixes(spark, "a"))) == []


def test_state(spark):
    pending = spark.createDataFrame([("p", "a", 1), ("p", "b", 5), ("p", "c", None)], KEY + ", detected_at int")
    assert rows(X.cleared(pending), "path") == [] and rows(X.cleared(pending, before=F.lit(3)), "path") == [("b",), ("c",)]
    assert rows(X.cleared(pending, paths(spark, "a", "b"), F.lit(5)), "path") == [("c",)]
    runs = spark.createDataFrame([(1, 3, 4), (2, 5, 6)], "id int, n int, m int")
    assert rows(X.closed(runs, spark.createDataFrame([(1, 9, None)], "id int, n int, m int"), "id", ["n", "m"])) == [(1, 9, 4), (2, 5, 6)]
    known = spark.createDataFrame([("/a", "m1")], "root_path string, embedding_model string")
    new = spark.createDataFrame([("/a", "m1"), ("/b", "m1"), ("/a", "m2")], known.schema)
    assert rows(X.registered(known, new)) == [("/a", "m1", False), ("/a", "m2", True), ("/b", "m1", False)]
    assert rows(X.lookup(spark.createDataFrame([("x", 1), ("x", 1)], "chunk_id string, n int"), spark.createDataFrame([("x",), ("?",)], "chunk_id string"))) == [("?", None), ("x", 1)]
    p = spark.createDataFrame([(1, 0, 10.0), (3, 12, 30.0)], "done int, total int, s double").select(*[c.alias(n) for n, c in X.progress(F.col("done"), F.col("total"), F.col("s")).items()])
    assert rows(p) == [(25.0, 90.0), (None, -10.0)] or rows(p)[0] == (25.0, 90.0)


def test_vector_guard(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "dense array<double>")
    assert X.guard_vectors(df, 2).count() == 2
    with pytest.raises(Exception, match="3 values was expected"):
        X.guard_vectors(df, 3).collect()


def test_verdicts_status_and_deltas(spark):
    diff = spark.createDataFrame([("p", "a", "new"), ("p", "b", "deleted"), ("q", "c", "unchanged")], KEY + ", bucket string")
    written = spark.createDataFrame([], KEY + ", chunks bigint")
    got = X.run_verdicts(X.run_counters(diff, paths(spark, "z", owner="q"), written), paths(spark, "z", owner="q"))
    assert rows(got, "project_id", "files_total", "failed", "all_failed", "clean", "may_advance") == [("p", 1, 0, True, False, False), ("q", 1, 1, False, False, True)]
    e = spark.createDataFrame([("p", 3), ("q", 2)], "project_id string, expected bigint")
    again = spark.createDataFrame([("p", 3), ("q", 9)], "project_id string, expected bigint")
    assert rows(X.status(e, again, spark.createDataFrame([("p", 2)], "project_id string, points bigint"))) == [("p", 3, 2, True), ("q", 2, 0, None)]
    b = spark.createDataFrame([("nl", 0.5), ("old", 0.1)], "category string, ndcg double")
    assert rows(X.metric_deltas(b, spark.createDataFrame([("nl", 0.75)], b.schema), ["ndcg"]), "category", "ndcg_gain") == [("nl", 0.25), ("old", None)]


def test_watched_events(spark):
    at = "2025-01-01 00:00:00"
    data = [(1, p, "modified", at) for p in ("src/a.py", ".git/x", "a/node_modules/b.js", "build", "k.pem", "uv.lock", "gen/a.py", "gen/keep.py")]
    ev = spark.createDataFrame(data, "owner int, path string, event string, at string")
    assert rows(E.watched(ev, ["gen/*", "!gen/keep.py"]), "path") == [("build",), ("gen/keep.py",), ("src/a.py",)]
    assert E.of_live_owners(ev, spark.createDataFrame([(2,)], "owner int")).count() == 0
    back = E.back_to_pending(ev.limit(1), spark.createDataFrame([(1, "src/a.py", at), (1, "z", at), (1, "z", at)], "owner int, path string, at string"))
    assert rows(back, "path", "event") == [("src/a.py", "modified"), ("z", "modified")]


def test_escapes_and_cut_off_entries():
    rules = compile_rules([r"\#x", r"a\*b"])
    assert ignored("#x", rules) and ignored("a*b", rules) and not ignored("axb", rules)
    assert gitstreams.parse_name_status(b"M\0a\0R100\0old\0new\0") == {"a", "old", "new"} and gitstreams.parse_name_status(b"M\0a\0R100\0old") == {"a", "old"}
    assert gitstreams.parse_porcelain(b" M a b\0R  new\0old\0?? z\0") == {"a b", "new", "old", "z"} and gitstreams.parse_porcelain(b"R  new") == {"new"} and gitstreams.parse_porcelain(b"") == set()
