"""Lexical searches shuffle rows, queries and hits, but no pairs of query words and postings."""

import importlib

import pytest

from tarnwork.operators import search as S
from tarnwork.plans.search import lexical_index

QUERIES = importlib.import_module("__spark_entry__").queries()
SMALL = "/root/testdata/sf0.01"


def shuffled(spark, run):
    """Records that the stages of run() wrote to shuffles."""
    sc = spark.sparkContext

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    run()
    return sum(n for stage, n in written().items() if stage not in before)


#: Registered queries and the records a document that they may shuffle on a stored index.
MOST = [("best_rank_per_source", 6), ("search_reranked", 6), ("search_hybrid", 6), ("search_code", 4.5), ("search_sparse_filtered", 2.5), ("eval_metrics", 4), ("search_sparse", 4)]


def test_the_index_shuffles_counts_of_words_only(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert shuffled(spark, lambda: S.lexical_index(docs, "doc_id", "text")) < 12 * docs.count()


@pytest.mark.parametrize("name,most", MOST)
def test_no_pairs_are_shuffled(spark, name, most):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    lexical_index(spark, SMALL)
    assert shuffled(spark, lambda: QUERIES[name](spark, SMALL).write.format("noop").mode("overwrite").save()) < most * docs


def test_filtered_search_over_many_groups(spark):
    texts = [["a b", "b b c", "a", "c d a", None, ""][i % 6] for i in range(240)]
    kinds = [[None, "x", "y"][i % 5 % 3] for i in range(240)]
    df = spark.createDataFrame(list(zip(range(240), texts, kinds)), "id bigint, text string, kind string")
    asked = df.where("id % 20 < 2").withColumnRenamed("id", "query_id")
    weights = S.bm25_weights(S.postings(df, "id", "text", ["kind"]), "id", ["kind"])
    got = {}
    for r in S.sparse(asked, weights, 7, filters=["kind"], block=40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    flat = S.bm25_weights(S.postings(df, "id", "text", ["kind"]), "id", ["kind"]).collect()
    idf = {r.term: r.idf for r in S.idfs(weights).collect()}
    want = {}
    for q in (i for i in range(240) if i % 20 < 2):
        mine = set((texts[q] or "").split())
        score = {r.id: round(sum(w * idf[t] for t, w in zip(r.terms, r.weights) if t in mine), 6) for r in flat if kinds[r.id] == kinds[q] and mine & set(r.terms)}
        if score:
            want[q] = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:7]
    assert got == want
