"""What the lexical searches hand to Python, how it is dealt and multiplied there, and that none of it changes a result."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tarnwork.operators import search as S
from tests.conftest import rows


def spied(monkeypatch, df, method):
    """Gets the data frame and arguments of each call of a method of data frames."""
    calls, own = [], getattr(type(df), method)
    monkeypatch.setattr(type(df), method, lambda self, *a: calls.append((self, a)) or own(self, *a))
    return calls


def sample(spark, n, seed=4):
    """Texts of four languages that share few words, each of a kind."""
    random.seed(seed)
    texts = [" ".join(random.choices([f"{'abcd'[i % 4]}{j}" for j in range(60)] + ["x", "y", f"own{i % 97}"], k=random.randint(1, 40))) for i in range(n)]
    return spark.createDataFrame([(i, t, "uvw"[i % 3]) for i, t in enumerate(texts)], "id bigint, text string, kind string")


def test_search_sparse_filtered_hands_no_arrays_of_rows_to_python(spark, monkeypatch):
    """An array column, also of nulls only, makes the JVM go value by value over all rows."""
    df = sample(spark, 400)
    calls = spied(monkeypatch, df, "mapInArrow")
    stored, idf = S.lexical_index(df, "id", "text", ["kind"])
    found = S.sparse(df.where("id % 20 = 0").withColumnRenamed("id", "query_id"), stored, 5, ["kind"], idf)
    big = [dict(d.dtypes) for d, _ in calls if "id" in d.columns]
    assert len(big) == 2 and not [t for d in big for t in d.values() if t.startswith("array")]
    monkeypatch.undo()
    listed = S.bm25_weights(S.postings(df, "id", "text", ["kind"]), "id", ["kind"])
    assert rows(found) == rows(S.sparse(df.where("id % 20 = 0").withColumnRenamed("id", "query_id"), listed, 5, ["kind"]))


def test_texts_that_are_left_uncut_are_cut_by_words(spark):
    """Characters beyond PLAIN, and bytes that are no characters, among empty and null texts."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["", "a b", "İstanbul a", None, "", "\U0001d7d8 b", "ΣΑΣ", "--"])], "id bigint, text string")
    df = df.unionByName(spark.range(1).select(F.lit(8).cast("bigint").alias("id"), F.unhex(F.lit("6120FF62C32062")).cast("string").alias("text")))
    for some in (df, df.where("id <> 8"), df.where("id < 2"), df.where("id = 2"), df.where("id = 0")):
        stored, idf = S.lexical_index(some, "id", "text")
        listed = S.bm25_weights(S.postings(some, "id", "text"), "id")
        asked = some.withColumnRenamed("id", "query_id")
        assert rows(S.sparse(asked, stored, 9, idf=idf)) == rows(S.sparse(asked, listed, 9)) and rows(idf) == rows(S.idfs(listed))


def test_eval_metrics_deals_each_core_the_same_number_of_groups(spark, monkeypatch):
    """Else the cores wait for the last few groups of the lexical channel."""
    df = sample(spark, 400)
    asked = df.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    stored, idf = S.lexical_index(df, "id", "text", ["kind"])
    want = rows(S.sparse(asked, stored, 10, idf=idf))
    calls = spied(monkeypatch, df, "repartitionById")
    for parts in (5, 6, 7, 8):
        postings = idf.agg(F.sum("df")).first()[0]
        assert rows(S.sparse(asked, stored, 10, idf=idf, block=-(-postings // parts))) == want
    assert [a[0] for _, a in calls] == [8, 8, 8, 8]


def test_search_sparse_multiplies_lines_only_with_rows_that_hold_them(spark, monkeypatch):
    """Rows of four languages stand in tiles; the scores, in the order of ids again, are those of brute force."""
    df = sample(spark, 3000)
    stored, idf = S.lexical_index(df, "id", "text", ["kind"])
    words = {r.term: r.idf for r in idf.collect()}
    texts = {r.id: Counter(r.text.split()) for r in df.collect()}
    asked = list(range(0, 3000, 50))
    listed = [sorted(texts[q]) for q in asked]
    parts = [pa.RecordBatch.from_pandas(stored.select("id", F.lit("").alias("_kind"), "terms", "tfs", "flat").toPandas(), preserve_index=False)]
    batch = pa.RecordBatch.from_arrays([pa.array(asked), pa.array([""] * len(asked)), pa.array([" ".join(w) for w in listed]), pa.array([[words[t] for t in w] for w in listed], pa.list_(pa.float64()))], ["query_id", "_kind", "terms", "weights"])
    made, own = [], np.matmul
    monkeypatch.setattr(S.np, "matmul", lambda a, b, **k: made.append(a.shape[0] * a.shape[1] * b.shape[1]) or own(a, b, **k))
    monkeypatch.setattr(S, "SORTED", 300, raising=False)
    got = {}
    for r in S._Group(parts).answer(batch, 10).to_pylist():
        got.setdefault(r["query_id"], []).append((-r["score"], r["id"], r["shared"]))
    often = Counter(t for c in texts.values() for t in c)
    assert sum(made) < 0.5 * len(asked) * 3000 * sum(n > S.LINE_SHARE * 3000 for n in often.values())
    mean = sum(c.total() for c in texts.values()) / 3000
    for q, mine in zip(asked, listed):
        score = {}
        for i, c in texts.items():
            if common := [t for t in mine if t in c]:
                score[i] = (round(math.fsum(words[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for t in common), 6), len(common))
        want = sorted((-s, i, n) for i, (s, n) in score.items())[:10]
        assert [(i, n) for _, i, n in got[q]] == [(i, n) for _, i, n in want] and max(abs(a[0] - b[0]) for a, b in zip(got[q], want)) < 2e-6
