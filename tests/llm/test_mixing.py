import heapq
import random
from collections import Counter

from tarnwork.llm.mixing import apportion, mix, shares, sized
from tests.conftest import rows


def slow(votes, seats, caps):
    held = [0] * len(votes)
    for _ in range(seats):
        best = heapq.nsmallest(1, [(-v / (2 * h + 1), i) for i, (v, h, c) in enumerate(zip(votes, held, caps)) if v > 0 and h < c])
        if not best:
            break
        held[best[0][1]] += 1
    return held


def test_apportion_gives_the_highest_quotients():
    random.seed(7)
    for _ in range(300):
        n = random.randint(1, 8)
        votes = [random.choice([0.0, 0.1, 0.25, 1.0, 3.7, random.random()]) for _ in range(n)]
        caps = [random.choice([0, 1, 5, 1000]) for _ in range(n)]
        seats = random.randint(0, 60)
        assert apportion(votes, seats, caps) == slow(votes, seats, caps)
    assert apportion([1.0, float("nan"), -1.0], 3, [9, 9, 9]) == [3, 0, 0]
    assert sum(apportion([0.5, 0.3, 0.2], 10**11, [10**12] * 3)) == 10**11


S = "doc_id bigint, source string, tokens int"
T = "mix_name string, source string, target_share double, max_repeats int, total_ratio double"


def test_mix_meets_shares_and_caps(spark):
    random.seed(8)
    docs = [(i, "big" if i < 3000 else "small" if i < 3030 else None if i < 3040 else "unlisted", random.randint(1, 300)) for i in range(3100)]
    sizes = spark.createDataFrame(docs, S)
    targets = spark.createDataFrame([("m", "big", 0.5, 1, 0.1), ("m", "small", 0.3, 50, 0.1), ("m", "none", 0.2, 1, 0.1), ("n", "small", 1.0, 2, 0.5), ("n", "small", 1.0, 2, 0.5)], T)
    for shard in (10**9, 20_000):
        got = mix(sizes, "doc_id", targets, block_tokens=64, shard_tokens=shard)
        r = got.collect()
        assert {x.source for x in r} == {"big", "small"} and max(x.repeats for x in r if x.mix_name == "n") <= 2
        assert all(n == 1 for n in Counter((x.mix_name, x.doc_id) for x in r).values())
        s = {(x.mix_name, x.source): x for x in shares(got, targets).collect()}
        assert abs(s["m", "big"].share - 0.625) < 0.02 and s["m", "none"].share == 0
        total = sum(t for _, _, t in docs)
        assert abs(sum(x.tokens * x.repeats for x in r if x.mix_name == "m") / total - 0.1) < 0.01
        small = sum(t for _, s_, t in docs if s_ == "small")
        assert sum(x.tokens * x.repeats for x in r if x.mix_name == "n") == 2 * small
    again = rows(mix(sizes, "doc_id", targets, block_tokens=64))
    assert again == rows(mix(sizes.repartition(5), "doc_id", targets, block_tokens=64))


def test_empty_and_odd_inputs(spark):
    targets = spark.createDataFrame([("m", "a", float("nan"), None, 1.0), ("m", None, 0.5, 0, None), ("q", "a", 1.0, None, 0.5)], T)
    sizes = spark.createDataFrame([(1, "a", 1000), (2, "a", 1000)], S)
    assert [x.repeats for x in mix(sizes, "doc_id", targets, block_tokens=10).where("mix_name = 'q'").collect()] == [1]
    assert mix(sizes.where("1=0"), "doc_id", targets).count() == 0 and mix(sizes, "doc_id", targets.where("1=0")).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "s", 5), (2, None, "s", 5), (3, "", "s", 5)], "doc_id bigint, text string, source string, tokens int")
    assert rows(sized(docs, "doc_id", "text", "source")) == [(1, "s", 3)]
