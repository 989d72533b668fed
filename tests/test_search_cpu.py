"""The lexical index is cut in Arrow batches as words cuts texts, and queries are scored and chosen many at once."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwork.functions.text import PLAIN, cut_words, plain, words
from tarnwork.operators import search as S
from tarnwork.plans.search import lexical_index
from tests.conftest import rows
from tests.test_search_size import SMALL


def test_plain_characters_are_cut_as_by_words(spark):
    known = [chr(c) for a, b in PLAIN for c in range(a, b + 1)]
    texts = [f"a{''.join(known[i : i + 50])}b {' '.join(known[i : i + 50])} {'x'.join(known[i : i + 50])}" for i in range(0, len(known), 50)] + ["", None, "--", "Ab_c é", "aя, " * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", words(F.col("text")).alias("w"), plain(F.col("text")).alias("p")).orderBy("id").collect()
    assert all(r.p for r in df)
    counts, found = cut_words(pa.array(texts))
    assert counts.tolist() == [len(r.w) for r in df] and found.to_pylist() == [w for r in df for w in r.w]


def test_other_characters_are_cut_by_words(spark):
    texts = ["İstanbul ist", "ΟΔΟΣ οδος ΣΑΣ", "a\U00010400b \U0001d7d8", "ABC ẞ", "plain", None, "É é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert [r.p for r in df.select(plain(F.col("text")).alias("p")).collect()] == [False] * 4 + [True] * 3
    want = {r.id: dict(Counter(r.w)) for r in df.select("id", words(F.col("text")).alias("w")).collect() if r.w}
    assert {r.id: dict(zip(r.terms, r.tfs)) for r in S.postings(df, "id", "text").collect()} == want


@pytest.mark.parametrize("name,k,filters", [("search_sparse_filtered", 10, ["kind"]), ("eval_metrics", 10, None), ("search_hybrid", 50, None), ("search_sparse", 10, None)])
def test_stored_index_holds_a_row_as_one_text_and_gives_the_same(spark, name, k, filters):
    """No array of a row's terms or counts is stored, shuffled or handed to Python, and none of it changes a score."""
    weights, _ = lexical_index(spark, SMALL)
    assert {"terms": "string", "tfs": "binary"}.items() <= dict(weights.dtypes).items(), name
    random.seed(9)
    texts = [" ".join(random.choices(["a", "b", "É", "ж", "İx", *(f"w{i}" for i in range(40))], k=random.randint(0, 30))) for _ in range(900)]
    df = spark.createDataFrame([(i, t, "xyz"[i % 3]) for i, t in enumerate(texts)], "id bigint, text string, kind string")
    asked = df.where("id % 30 = 0").withColumnRenamed("id", "query_id")
    stored, idf = S.lexical_index(df, "id", "text", ["kind"])
    post = S.postings(df, "id", "text", ["kind"])
    listed = S.bm25_weights(post, "id", ["kind"])
    assert rows(S.sparse(asked, stored, k, filters, idf, block=4000)) == rows(S.sparse(asked, listed, k, filters))
    assert rows(idf) == rows(S.idfs(listed))


def test_more_open_rows_than_are_scored_at_once(spark):
    """Equal scores of all rows, so that every row of a block may be among the best of every query."""
    df = spark.range(6000).withColumn("text", F.lit("a b"))
    asked = df.where("id < 9").withColumnRenamed("id", "query_id")
    stored, idf = S.lexical_index(df, "id", "text")
    got = rows(S.sparse(asked, stored, 3, idf=idf), "query_id", "rank", "id")
    assert got == [(q, r, r - 1) for q in range(9) for r in (1, 2, 3)]
