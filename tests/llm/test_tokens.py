import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from tarnwork.llm.tokens import WORDS, Encoder, encode_corpus, load_ranks, token_count, vocabulary

TEXTS = [
    None, "", " ", "\n\n \t x", "Hello world's <|endoftext|> don't", "naïve Größe 漢字 это 👩‍💻", "a" * 5000, "=" * 333, "\x00\x07\r\n", "x\ud800y", "12345 67 8.9e10", "  leading", "trailing  ",
    "def f(x):\n    return {'a': [1, 2]}\n" * 50, "ab" * 40_000,
]


@pytest.fixture(scope="module")
def ref():
    return tiktoken.Encoding("ref", pat_str=WORDS, mergeable_ranks=load_ranks(vocabulary()), special_tokens={})


def want(ref, t):
    return ref.encode_ordinary(t) if t else []


def test_equals_the_reference_encoder(ref):
    e = Encoder(load_ranks(vocabulary()))
    texts = [t for t in TEXTS if t is None or "\ud800" not in t]
    assert list(e.encode(texts)) == [want(ref, t) for t in texts]
    assert list(e.encode(texts)) == [want(ref, t) for t in texts]  # from memory


def test_random_words_and_a_small_memory(ref):
    random.seed(5)
    e = Encoder(load_ranks(vocabulary()), cache_words=50)
    for _ in range(20):
        words = ["".join(random.choice("abcdeinrstéя_-= 语") for _ in range(random.randint(1, 30))) for _ in range(100)]
        assert list(e.encode(words)) == [want(ref, t) for t in words]


def test_operator(spark, ref):
    texts = [t for t in TEXTS if t is None or ("\ud800" not in t and "\x00" not in t)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: list(r.ids) for r in encode_corpus(df).collect()}
    assert got == {i: want(ref, t) for i, t in enumerate(texts)}
    n = {r[0]: r[1] for r in df.select("doc_id", token_count(F.col("text"))).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert encode_corpus(df.where("1=0")).count() == 0
