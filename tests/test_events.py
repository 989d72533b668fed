from datetime import datetime, timedelta

from tarnwork.streaming import events as E
from tests.conftest import rows

RAW = "owner bigint, path string, target string, event string, is_dir boolean, at timestamp, seq bigint"


def raw(spark, *events):
    base = datetime(2025, 1, 1)
    return spark.createDataFrame([(1, p, t, e, d, base + timedelta(seconds=s), n) for n, (p, t, e, d, s) in enumerate(events)], RAW)


def test_normalise_and_coalesce(spark):
    df = raw(spark, ("a", None, "created", False, 0), ("a", None, "modified", False, 1), ("b", "c", "moved", False, 2), ("d", None, "modified", True, 3), ("e", None, "deleted", True, 3), ("f~", None, "modified", False, 4), ("g", None, "opened", False, 5), ("b", None, "created", False, 6))
    got = rows(E.coalesced(E.normalised(df)), "path", "event", "seen")
    assert got == [("a", "created", 2), ("b", "created", 2), ("c", "created", 1), ("e", "deleted", 1)]


def test_pending_and_sessions(spark):
    ev = E.normalised(raw(spark, ("a", None, "modified", False, 0), ("b", None, "modified", False, 100), ("a", None, "modified", False, 101)))
    assert rows(E.pending_after(ev, "2025-01-01 00:01:40"), "path") == [("a",)]
    assert rows(E.quiet_periods(ev, "10 seconds"), "events") == [(1,), (2,)]
    assert rows(E.daily_counters(ev), "seen", "coalesced") == [(3, 1)]


def test_stream_equals_batch(spark, tmp_path):
    kinds = ["created", "modified", "deleted", "modified"]
    df = raw(spark, *[(f"p{i % 5}", None, kinds[i * 7 % 4], False, i) for i in range(40)])
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = E.normalised(spark.readStream.schema(RAW).parquet(str(tmp_path / "e")))
    assert rows(E.drain(E.coalesced(stream), ["owner", "path"], "seen"), "path", "event", "seen") == rows(E.coalesced(E.normalised(df)), "path", "event", "seen")


def test_an_empty_stream_drains_to_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "owner bigint, path string, target string, event string, is_dir boolean, at timestamp, seq bigint")
    df.write.parquet(str(tmp_path / "none"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "none"))
    assert E.drain(E.coalesced(E.normalised(stream)), ["owner", "path"], "seen").collect() == []
