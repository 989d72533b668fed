import math
import random
from collections import Counter

import numpy as np

from tarnwork.operators import search as S
from tarnwork.operators.evaluation import best_per_file, query_metrics, relevant_hits
from tests.conftest import rows


def test_dense_equals_brute_force_over_several_blocks(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(-2, 3, (300, 4)).astype(float)
    data = [(i, v.tolist(), i % 3) for i, v in enumerate(m)] + [(900, None, 0)]
    df = spark.createDataFrame(data, "id bigint, vector array<double>, label int")
    asked = df.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.rank): (r.id, r.score) for r in S.dense(asked, df, 5, block=70).collect()}
    n = np.linalg.norm(m, axis=1)
    u = m / np.where(n > 0, n, 1)[:, None]
    for q in range(0, 300, 10):
        best = sorted(range(300), key=lambda j: (-round(float(u[q] @ u[j]), 6), j))[:5]
        assert [got[q, k + 1][0] for k in range(5)] == best
    same = S.dense(asked, df, 5, filters=["label"]).join(df.select("id", "label"), "id").collect()
    assert all(r.query_id % 3 == r.label for r in same)
    assert S.dense(asked.where("1=0"), df, 5).count() == 0 and S.dense(asked, df.where("1=0"), 5).count() == 0


def test_sparse_equals_brute_force(spark):
    random.seed(2)
    texts = [" ".join(random.choice("alpha beta gamma delta eps".split()) for _ in range(random.randint(0, 9))) for _ in range(80)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    asked = df.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    weights = S.bm25_weights(S.postings(df, "id", "text"), "id")
    got = rows(S.sparse(asked, weights, 5), "query_id", "rank", "id", "score")
    tok = {i: (t or "").split() for i, t in enumerate(texts)}
    live = {i: w for i, w in tok.items() if w}
    n, avg = len(live), sum(map(len, live.values())) / len(live)
    df_ = Counter(w for ws in live.values() for w in set(ws))
    want = []
    for q in range(0, 81, 10):
        score = {}
        for i, ws in live.items():
            c = Counter(ws)
            s = sum(math.log(1 + (n - df_[w] + 0.5) / (df_[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(ws) / avg)) for w in set(tok[q]) if w in c)
            if any(w in c for w in tok[q]):
                score[i] = round(s, 6)
        want += [(q, k + 1, i, score[i]) for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5])]
    assert [x[:3] for x in got] == sorted([x[:3] for x in want], key=str)


def test_ivf_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    m = np.concatenate([c + 0.2 * rng.normal(size=(60, 16)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vector array<double>")
    asked = df.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    index, fitted = S.ivf_index(df, 12)
    assert index.count() == 720
    found = {tuple(r) for r in S.ivf_search(asked, index, fitted, 10, 4).select("query_id", "id").collect()}
    exact = {tuple(r) for r in S.dense(asked, df, 10).select("query_id", "id").collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_fuse_and_rerank(spark):
    h = lambda x: spark.createDataFrame(x, "query_id int, id int, rank int")
    fused = rows(S.fuse([h([(1, 10, 1), (1, 11, 2)]), h([(1, 11, 1)])], 5), "id", "rank")
    assert fused == [(10, 2), (11, 1)]
    hits = spark.createDataFrame([(1, 10, 0.3, 1), (1, 11, 0.2, 2), (1, 12, 0.1, 3)], "query_id int, id int, score double, rank int")
    q = spark.createDataFrame([(1, "jwt claims")], "query_id int, text string")
    t = spark.createDataFrame([(10, "nothing"), (11, "jwt"), (12, "jwt claims x")], "id int, text string")
    assert rows(S.rerank(hits, q, t, 2), "id", "rerank_score", "rank") == [(11, 0.5, 2), (12, 1.0, 1)]


def test_metrics(spark):
    hits = spark.createDataFrame([("q", i, i) for i in range(1, 11)], "query_id string, id int, rank int")
    labels = spark.createDataFrame([("q", 6, "nl"), ("z", 1, "nl")], "query_id string, id int, category string")
    got = {r.query_id: r for r in query_metrics(hits, labels).collect()}
    assert got["q"].recall_5 == 0 and got["q"].recall_10 == 1 and abs(got["q"].ndcg_10 - 0.3562) < 1e-4 and got["z"].ndcg_10 == 0
    lines = spark.createDataFrame([("q", "f", 90, 100), ("q", "f", 80, 99), ("q", "g", 1, 2)], "query_id string, file string, start_line int, end_line int")
    rel = spark.createDataFrame([("q", "f", 100, 120), ("q", "g", None, None)], "query_id string, file string, start_line int, end_line int")
    assert rows(relevant_hits(lines, rel), "file", "start_line") == [("f", 90), ("g", 1)]
    two = spark.createDataFrame([("q", "f", 1), ("q", "g", 2), ("q", "f", 3)], "query_id string, file string, rank int")
    assert rows(best_per_file(two), "file", "rank") == [("f", 1), ("g", 2)]
