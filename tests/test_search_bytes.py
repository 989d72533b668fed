"""Lexical searches shuffle few bytes, choose rows by single precision without losing one, and rerank without reading texts again."""

import random

import pytest

from tarnwork.operators import search as S
from tarnwork.plans.search import lexical_index
from tests.conftest import rows
from tests.test_search_size import QUERIES, SMALL

#: Registered queries and the bytes a document that they may shuffle on a stored index.
MOST = [("search_reranked", 500), ("search_code", 500), ("search_sparse_filtered", 500), ("eval_metrics", 500), ("search_sparse", 500), ("search_hybrid", 500)]


def shuffled_bytes(spark, run):
    """Bytes that the stages of run() wrote to shuffles."""
    sc = spark.sparkContext

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = written()
    run()
    return sum(n for stage, n in written().items() if stage not in before)


@pytest.mark.parametrize("name,most", MOST)
def test_few_bytes_are_shuffled(spark, name, most):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    lexical_index(spark, SMALL)
    assert shuffled_bytes(spark, lambda: QUERIES[name](spark, SMALL).write.format("noop").mode("overwrite").save()) < most * docs


def corpus(spark, n=4000):
    """Texts of common, rarer and single words, some equal, some without words, and every 80th as a query."""
    random.seed(5)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(600)]
    texts = [" ".join(random.sample(common, random.randint(0, 9)) + random.choices(rare, k=random.randint(0, 4))) + f" u{i}" * (i % 3 == 0) for i in range(n)]
    texts = [texts[i % 700] if i % 5 == 0 else texts[i] for i in range(n)]
    texts[80], texts[81] = None, "--"
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    return df, df.where("id % 80 = 0").withColumnRenamed("id", "query_id"), texts


def test_single_precision_loses_no_row(spark, monkeypatch):
    df, asked, texts = corpus(spark)
    weights = S.bm25_weights(S.postings(df, "id", "text"), "id")
    idf = {r.term: r.idf for r in S.idfs(weights).collect()}
    held = {r.id: dict(zip(r.terms, r.weights)) for r in weights.collect()}
    want = {}
    for q in range(0, len(texts), 80):
        mine = set((texts[q] or "").split())
        score = {i: (round(sum(w * idf[t] for t, w in ws.items() if t in mine), 6), len(mine & set(ws))) for i, ws in held.items() if mine & set(ws)}
        if score:
            want[q] = [(i, *score[i]) for i in sorted(score, key=lambda i: (-score[i][0], i))[:7]]
    for block, together in ((S.POSTINGS, S.SCORES_BYTES), (3000, 1)):  # also one query at a time, over several groups
        monkeypatch.setattr(S, "SCORES_BYTES", together)
        got = {}
        for r in S.sparse(asked, weights, 7, block=block, shared=True).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.score, r.shared))
        assert got == want


def test_rerank_by_texts_terms_and_shared_words(spark):
    df, asked, _ = corpus(spark)
    post = S.postings(df, "id", "text")
    hits = S.sparse(asked, S.bm25_weights(post, "id"), 20, shared=True).cache()
    none = spark.createDataFrame([(160, 81, 0.0, 21, 0), (80, 3, 0.0, 1, 0)], "query_id bigint, id bigint, score double, rank int, shared int")
    hits = hits.select(none.columns).union(none)
    columns = ["query_id", "id", "rerank_score", "rank"]
    by_text = rows(S.rerank(hits.drop("shared"), asked, df, 9), *columns)
    assert by_text and by_text == rows(S.rerank(hits.drop("shared"), asked, post, 9), *columns) == rows(S.rerank(hits, asked, df, 9), *columns)
