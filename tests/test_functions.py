import unicodedata
from uuid import UUID, uuid5

from pyspark.sql import functions as F

from tarnwork.functions import hashing, paths, text, vectors
from tarnwork.functions.globs import compile_rules, glob_regex, ignored
from tests.conftest import rows


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_canonical_path(spark):
    c = lambda x: one(spark, x, paths.canonical_path)
    assert c("./a\\b/c.py") == "a/b/c.py"
    assert c(unicodedata.normalize("NFD", "src/größe.py")) == "src/größe.py"
    assert c("././x") == "x" and c("") == "" and c(None) is None and c("a./b") == "a./b"


def test_path_parts(spark):
    assert one(spark, "a/b/c.py", paths.ancestors) == ["a", "a/b"]
    assert one(spark, "c.py", paths.ancestors) == []
    assert one(spark, "a/.py", paths.suffix) == "" and one(spark, "a/B.PY", paths.suffix) == ".py"
    assert one(spark, "a/b.py", text.language_of) == "python" and one(spark, "a/b.zzz", text.language_of) is None
    df = spark.createDataFrame([("src2/x", "src"), ("src/x", "src"), ("src", "src")], "p string, q string")
    assert [r[0] for r in df.select(paths.under(F.col("p"), F.col("q"))).collect()] == [False, True, True]


def test_uuid5_and_hashes(spark):
    ns = UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    for x in ("a", "p:src/größe.py:1:ff", ""):
        assert one(spark, x, lambda c: hashing.uuid5(ns, c)) == str(uuid5(ns, x))
    v = one(spark, "abc", lambda c: hashing.pseudo_vector(c, 40))
    assert len(v) == 40 and all(-1 <= x <= 1 for x in v)


def test_text_functions(spark):
    assert one(spark, "a_B cD-1", text.words) == ["a", "b", "cd", "1"]
    assert one(spark, None, text.words) == []
    assert one(spark, "a b\ncde", text.token_estimate) == 2 and one(spark, "", text.token_estimate) == 0
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1] is None and got[2] is None


def test_globs():
    rules = compile_rules(["# c", "", "*.log", "!keep.log", "build/", "/top.txt", "docs/**/x.md"])
    assert ignored("a/b.log", rules) and not ignored("a/keep.log", rules)
    assert ignored("build/keep.log", rules)  # nothing below an ignored directory comes back
    assert ignored("top.txt", rules) and not ignored("a/top.txt", rules)
    assert ignored("docs/x.md", rules) and ignored("docs/a/b/x.md", rules) and not ignored("x.md", rules)
    assert glob_regex("a[!b]?.c") == "^(?:.*/)?a[^b][^/]\\.c$"


def test_quantiles(spark):
    from tarnwork.operators.quantiles import exact_at, index_position, nearest_rank

    data = [("a", float(i)) for i in range(1, 101)] + [("b", 1.0)] * 500 + [("b", None), (None, 2.0)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r.g: (r.n, r.p50, r.p95, r.i50) for r in exact_at(df, ["g"], "x", {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95), "i50": index_position(0.5)}).collect()}
    assert got["a"] == (100, 50.0, 95.0, sorted(range(1, 101))[round(0.5 * 99)]) and got["b"] == (500, 1.0, 1.0, 1.0) and got[None] == (1, 2.0, 2.0, 2.0)
    assert rows(exact_at(df.where("1=0"), ["g"], "x", {"p": nearest_rank(0.5)})) == []
