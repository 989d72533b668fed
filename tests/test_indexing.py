import os
import subprocess

import pytest

from tarnwork.operators import indexing as I
from tarnwork.operators import runs as R
from tarnwork.operators.chunking import chunk_texts, cut, estimate
from tarnwork.operators.structural import Pattern, restricted_paths, search_files, structural_search
from tarnwork.sources import gitstreams, labels
from tarnwork.sources.filesystem import CodeTree
from tarnwork.sources.snapshots import SnapshotTable
from tests.conftest import rows


def test_hash_diff(spark):
    stored = spark.createDataFrame([("same", "h"), ("edited", "old"), ("gone", "h"), ("nil", None)], "path string, h string")
    found = spark.createDataFrame([("same", "h"), ("edited", "new"), ("fresh", "h"), ("nil", None)], "path string, h string")
    assert rows(I.hash_diff(stored, found, ["path"], "h")) == [("edited", "changed"), ("fresh", "new"), ("gone", "deleted"), ("nil", "unchanged"), ("same", "unchanged")]


def test_upsert_prune_sweep(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, t string")
    new = spark.createDataFrame([("b", 3, "z"), ("c", 4, None)], "k string, n int, t string")
    assert rows(I.upsert(old, new, ["k"])) == [("a", 1, "x"), ("b", 3, "z"), ("c", 4, None)]
    points = spark.createDataFrame([("f", "1", "p"), ("f", "2", "p"), ("g", "1", "q")], "path string, file_hash string, project_id string")
    files = spark.createDataFrame([("f", "2")], "path string, content_hash string")
    assert rows(I.prune(points, files, ["path"]), "path", "file_hash") == [("f", "2"), ("g", "1")]
    with pytest.raises(ValueError):
        I.sweep(points, points.where("1=0"))
    assert I.sweep(points, points.where("project_id = 'q'")).count() == 1


def test_ledger_and_prefixes(spark):
    old = spark.createDataFrame([("a", 2), ("b", 1)], "d string, runs bigint")
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "d string")
    assert rows(I.ledger(old, one("a", "c"), one("b"), ["d"], 3)) == [("a", 3, True), ("c", 1, False)]
    files = spark.createDataFrame([("p", "src/a/x"), ("p", "src2/y"), ("q", "src/z")], "project_id string, path string")
    dirs = spark.createDataFrame([("p", "src"), ("p", "src/a/x")], "project_id string, prefix string")
    assert rows(I.with_ancestor(files, dirs, ["project_id"]), "path", "prefix") == [("src/a/x", "src"), ("src/a/x", "src/a/x")]


def test_streaks(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate("FFOFFF")] + [(2, 0, "O")], "o int, i int, s string")
    assert rows(R.streaks(df, "o", ["i"], "s = 'F'"), "o", "longest", "current") == [(1, 3, 3), (2, 0, 0)]
    assert rows(R.since_last(df, "o", ["i"], "s = 'O'")) == [(1, 3), (2, 0)]


CODE = 'import os\n\n@cached\ndef a(x):\n    """doc"""\n    return x\n\n\nclass B:\n    def m(self):\n        pass\n'


def test_chunks_give_the_text_again(spark):
    for text in (CODE, "", "\n\n", "x", "x\r\ny\r\n", "a" * 20000 + "\nb", CODE * 200, "π\u2028ü\x0c\n" * 30):
        for budget in (1, 10, 800):
            got = cut(text, "python", budget)
            assert "".join(p[4] for p in got) == text
            assert all(b[0] == a[1] + 1 for a, b in zip(got, got[1:]))
            assert all(sum(map(estimate, p[4].split("\n"))) <= budget or p[0] == p[1] for p in got)
    assert [p[3] for p in cut(CODE, "python")] == [None, "a", "B", "m"]
    df = spark.createDataFrame([(1, None), (2, CODE)], "id int, text string")
    assert chunk_texts(df, ["id"], "text").count() == 1


PY = 'import sqlite3\nfrom x import y\ndef query_users(db, n):\n    # db.Exec("no")\n    return db.Exec("select (1, 2)", ctx)\ndef render():\n    print("rendering")\n'


def test_structural(spark):
    df = spark.createDataFrame([("a.py", 1, PY), ("b.py", 1, None), ("c.py", 11, PY)], "path string, start_line int, text string")
    find = lambda p: sorted((r.path, r.start_line, r.matched, dict(r.singles), {k: list(v) for k, v in r.lists.items()}) for r in structural_search(df, ["path"], "text", "start_line", p, "python").collect())
    assert find("db.Exec($$$ARGS)")[0] == ("a.py", 5, 'db.Exec("select (1, 2)", ctx)', {}, {"ARGS": ['"select (1, 2)"', "ctx"]})
    assert [x[1] for x in find("db.Exec($$$ARGS)")] == [5, 15]
    assert [x[3] for x in find("import $MOD")] == [{"MOD": "sqlite3"}] * 2
    assert [x[3]["NAME"] for x in find("def $NAME($$$P): $$$BODY")[:2]] == ["query_users", "render"]
    assert find("print($MSG)")[0][3] == {"MSG": '"rendering"'}
    for bad in ("", "$X", "f(("):
        with pytest.raises(ValueError):
            Pattern(bad, "python")


def test_code_tree(spark, tmp_path):
    for p, t in {"app/__init__.py": "x", "app/.gitignore": "gen.py\n", "app/gen.py": "x", "app/sub/gen.py": "x", ".github/w.yml": "a: 1", ".env": "S=1", "keys/service.pem": "k", "node_modules/a.js": "x", "go.sum": "x", "big.txt": "y" * 2_000_000}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "bin.dat").write_bytes(b"a\x00b")
    (tmp_path / "bad.txt").write_bytes(b"a\xffb")
    os.symlink(tmp_path / "bad.txt", tmp_path / "link.txt")
    spark.dataSource.register(CodeTree)
    got = {r.path: r for r in spark.read.format("code_tree").option("root", str(tmp_path)).load().collect()}
    assert sorted(got) == [".github/w.yml", "app/.gitignore", "app/__init__.py", "bad.txt"]
    assert got["bad.txt"].text == "a\ufffdb" and got["bad.txt"].bytes == 3


def test_git_streams():
    assert gitstreams.parse_name_status(b"M\0a\0R100\0old\0new\0D\0gone\0") == {"a", "old", "new", "gone"}
    assert gitstreams.parse_porcelain(b" M a b\0R  new\0old\0?? x\0") == {"a b", "new", "old", "x"}
    assert gitstreams.below({"s/a", "t/b", "s"}, "s/") == {"a"}


def test_git_candidates(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a").write_text("1")
    git("add", "."), git("commit", "-qm", "1")
    (tmp_path / "a").write_text("2")
    (tmp_path / "b").write_text("1")
    assert rows(gitstreams.candidates(spark, str(tmp_path), "HEAD")) == [("a",), ("b",)]
    assert gitstreams.candidates(spark, str(tmp_path / "none"), "HEAD") is None


def test_snapshot_table(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    t.upsert(df, ["k"])
    t.upsert(spark.createDataFrame([("b", 5), ("c", 6)], "k string, n int"), ["k"])
    assert rows(t.read(), "k", "n") == [("a", 1), ("b", 5), ("c", 6)]


def test_labels_and_settings(spark, tmp_path):
    f = tmp_path / "g.json"
    f.write_text('[{"id": "q1", "category": "nl", "query": "x", "relevant": [{"path": "a.py", "lines": [1, 3]}, {"path": "b.py"}]}]')
    assert labels.load_labels(spark, str(f)).first().relevant[0].end_line == 3
    f.write_text('[{"id": "q1", "category": "odd", "query": "x", "relevant": [{"path": "a.py"}]}]')
    with pytest.raises(ValueError):
        labels.load_labels(spark, str(f))
    s = tmp_path / "s.toml"
    s.write_text('top_k = 5\nlanguages = ["go"]\n')
    assert labels.load_settings(str(s)).top_k == 5 and labels.load_settings().top_k == 10
    s.write_text('top_k = "5"\n')
    with pytest.raises(ValueError):
        labels.load_settings(str(s))


def test_structural_search_over_whole_files(spark):
    text = ["def f(a):\n    db.Exec(\n", "        'x', a)\n    db.Exec(b)\n"]
    data = [("p", "src/a.py", "h", "1", 1, "python", text[0]), ("p", "src/a.py", "h", "2", 3, "python", text[1]), ("p", "lib/b.py", "h", "3", 1, "Python", text[1][17:]), ("p", "src/c.js", "h", "4", 1, "javascript", "db.Exec(1)\n"), ("p", "src/n.py", "h", "5", None, None, None)]
    df = spark.createDataFrame(data + data[:1], "project_id string, path string, file_hash string, chunk_id string, start_line int, language string, text string")
    got = search_files(df, "db.Exec($$$ARGS)", "python", paths=["./src/"])
    assert rows(got, "path", "start_line", "end_line", "truncated") == [("src/a.py", 2, 3, False), ("src/a.py", 4, 4, False)]
    assert rows(got.selectExpr("size(lists['ARGS']) n")) == [(1,), (2,)]
    assert rows(search_files(df, "db.Exec($$$ARGS)", "python", max_results=2), "path", "truncated") == [("lib/b.py", True), ("src/a.py", True)]
    assert rows(search_files(df, "db.Exec($$$ARGS)", "python", max_results=9), "truncated") == [(False,)] * 3
    for bad in (dict(max_results=0), dict(paths=[""]), dict(paths=["/etc"]), dict(paths=["a/../b"])):
        with pytest.raises(ValueError):
            search_files(df, "db.Exec($X)", "python", **bad)
    with pytest.raises(ValueError):
        search_files(df, "db.Exec(", "python")
    assert restricted_paths(["a\\\\b/", "./c//d"]) == ["a/b", "c/d"]
