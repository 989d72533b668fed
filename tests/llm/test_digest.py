import math

import numpy as np

from tarnwork.llm.digest import certify, clusters, estimates, measurements, merge_digests, partial_digests, rank_bound
from tests.conftest import rows

QS = [0.5, 0.9, 0.99]


def test_clusters_keep_weight_and_order():
    v = np.sort(np.random.default_rng(1).lognormal(size=20_000))
    m, w = clusters(v, np.ones(len(v)), 200)
    assert w.sum() == 20_000 and len(m) <= 201 and (np.diff(m) > 0).all() and w[0] < w.max() / 10


def rank_error(values, q, x):
    n = len(values)
    return max(0, (values < x).sum() - q * n, q * n - (values <= x).sum()) / n


def test_merged_percentiles_are_within_the_bound(spark):
    rng = np.random.default_rng(2)
    data = {("a", d): np.round(rng.lognormal(d, 1, 6000), 3) for d in range(3)} | {("hot", 0): np.minimum(rng.exponential(9, 40_000), 20.0), ("one", 0): np.array([7.0])}
    df = spark.createDataFrame([(g, d, float(x)) for (g, d), v in data.items() for x in v], "g string, d int, x double").repartition(7)
    days = merge_digests(partial_digests(df, ["g", "d"], "x"), ["g", "d"])
    whole = merge_digests(days.drop("d"), ["g"])
    est = estimates(whole, ["g"], QS).cache()
    for r in est.collect():
        values = np.concatenate([v for (g, _), v in data.items() if g == r.g])
        assert r.n == len(values)
        for q, x in zip(QS, r.est):
            assert rank_error(values, q, x) <= rank_bound(q, clusterings=5) + 1 / r.n
    hot = [tuple(r) for r in certify(df.select("g", "x"), ["g"], "x", est, QS, 10**9).orderBy("g").select("g", "below", "upto").collect()]
    few = [tuple(r) for r in certify(df.select("g", "x"), ["g"], "x", est, QS, 3).orderBy("g").select("g", "below", "upto").collect()]
    assert hot == few and len(hot) == 3


def test_measurements(spark):
    nan = math.nan
    data = [(1, "a", None), (1, "a", 5.0), (1, "a", 5.0), (2, "a", nan), (3, None, 0.0), (None, "a", 1.0), (None, "a", 1.0), (4, "b", math.inf)]
    df = spark.createDataFrame(data, "id bigint, g string, x double")
    assert rows(measurements(df, "id", "x", ["g"])) == sorted([("a", 5.0), (None, 0.0), ("a", 1.0), ("a", 1.0), ("b", math.inf)], key=str)
    assert measurements(df.where("1=0"), "id", "x", ["g"]).count() == 0


def test_empty_and_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "g string, x double")
    got = merge_digests(partial_digests(df, ["g"], "x"), ["g"])
    assert rows(estimates(got, ["g"], [0.5])) == [(None, 2, [2.0])]
    assert merge_digests(partial_digests(df.where("1=0"), ["g"], "x"), ["g"]).count() == 0


def test_a_long_task_clusters_each_value_once(spark, monkeypatch):
    import tarnwork.llm.digest as digest

    monkeypatch.setattr(digest, "FLUSH", 1000)
    values = np.random.default_rng(5).lognormal(size=60_000)
    df = spark.createDataFrame([("a", float(x)) for x in values], "g string, x double").coalesce(1)
    got = merge_digests(partial_digests(df, ["g"], "x"), ["g"])
    (_, n, est), = rows(estimates(got, ["g"], QS))
    assert n == 60_000 and all(rank_error(values, q, x) <= rank_bound(q) + 1 / n for q, x in zip(QS, est))
    assert got.count() <= 401
