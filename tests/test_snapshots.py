from datetime import datetime

from tarnwork.operators.compare import state_against_store
from tarnwork.operators.snapshots import snapshot_changes
from tests.conftest import rows

S = "no int, p string, path string, h string, at timestamp, extra map<string,string>"


def changes(spark, data):
    return rows(snapshot_changes(spark.createDataFrame(data, S), "no", ["p", "path"], "h", "at"))


def t(n):
    return datetime(2025, 1, n)


def test_added_removed_changed_over_gaps(spark):
    data = [(1, "a", "x", "1", t(1), None), (4, "a", "x", "2", t(2), None), (9, "a", "y", "1", t(3), None), (1, "a", "z", "1", t(1), None), (9, "a", "z", "1", t(1), None)]
    assert changes(spark, data) == [(4, "a", "x", "changed"), (4, "a", "z", "removed"), (9, "a", "x", "removed"), (9, "a", "y", "added"), (9, "a", "z", "added")]


def test_latest_row_of_a_snapshot_holds_and_null_is_earliest(spark):
    data = [(1, "a", "x", "1", t(1), {}), (2, "a", "x", "1", t(5), {}), (2, "a", "x", "2", t(4), {}), (2, "a", "x", "3", None, {})]
    assert changes(spark, data) == []


def test_repeats_nulls_and_empty(spark):
    assert changes(spark, []) == []
    data = [(1, "a", "x", None, None, None)] * 3 + [(2, "a", "x", None, None, None), (None, "a", "q", "1", None, None), (2, None, "q", "1", None, None), (2, "a", None, "1", None, None)]
    assert changes(spark, data) == []
    assert changes(spark, data + [(3, "a", "x", "1", None, None)]) == [(3, "a", "x", "changed")]


def test_one_snapshot_has_no_changes(spark):
    assert changes(spark, [(7, "a", "x", "1", t(1), None)]) == []


F_ = "project_id string, path string, chunk_count bigint, content_hash string, language string"
C_ = "project_id string, path string, chunk_id string, file_hash string, language string"


def diff(spark, files, chunks):
    return rows(state_against_store(spark.createDataFrame(files, F_), spark.createDataFrame(chunks, C_)), "path", "difference")


def test_state_against_store(spark):
    files = [("p", "same", 2, "h", "go"), ("p", "same", 2, "h", "go"), ("p", "none", 0, "h", None), ("p", "gone", 1, "h", None), ("p", "bad", 3, "h", None), ("p", "old", 2, "h", "go"), ("p", "nolang", 1, "h", None), ("p", "count?", None, "h", None)]
    chunks = [("p", "same", "1", "h", "go"), ("p", "same", "2", "h", "go"), ("p", "same", "2", "h", "go"), ("p", "extra", "3", "h", None), ("p", "bad", "4", "h", "c"), ("p", "old", "5", "h", "go"), ("p", "old", "6", "other", None), ("p", "nolang", "7", "h", None)]
    assert diff(spark, files, chunks) == [("bad", "chunk_count"), ("bad", "language"), ("extra", "missing_in_state"), ("gone", "missing_in_store"), ("old", "content_hash"), ("old", "language")]


def test_state_against_store_empty(spark):
    assert diff(spark, [], []) == []
    assert diff(spark, [("p", "x", 1, "h", None)], []) == [("x", "missing_in_store")]
    assert diff(spark, [], [("p", "x", "1", "h", None)] * 50) == [("x", "missing_in_state")]


def test_hot_key(spark):
    chunks = [("p", "hot", str(i % 300), "h", "go") for i in range(3000)] + [("p", str(i), "c", "h", "go") for i in range(50)]
    files = [("p", "hot", 300, "h", "go")] + [("p", str(i), 1, "h", "go") for i in range(50)]
    assert diff(spark, files, chunks) == []


def test_many_deliveries_without_broadcast(spark):
    data = [(n * 3, "a", str(k), str(n // 2), t(1), None) for n in range(40) for k in range(5) if (n + k) % 7]
    df = spark.createDataFrame(data, S)
    here, joined = (rows(snapshot_changes(df, "no", ["p", "path"], "h", "at", broadcast=b)) for b in (100, 3))
    kept = {(no, path): h for no, _, path, h, _, _ in data}
    numbers = sorted({d[0] for d in data})
    want = []
    for a, b in zip(numbers, numbers[1:]):
        for k in map(str, range(5)):
            x, y = kept.get((a, k)), kept.get((b, k))
            if x != y:
                want.append((b, "a", k, "added" if x is None else "removed" if y is None else "changed"))
    assert here == joined == sorted(want, key=str)
