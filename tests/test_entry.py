"""Every registered query with SQL gives the rows of its SQL on the smallest tables."""

import importlib
import os

import duckdb
import pandas as pd
import pytest

entry = importlib.import_module("__spark_entry__")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def text(x):
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, float) or type(x).__name__.startswith("float"):
        return "null" if x != x else f"{x:.5g}"
    if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
        return "null"
    if hasattr(x, "isoformat"):
        t = pd.Timestamp(x)
        return str(t.tz_convert("UTC").tz_localize(None) if t.tzinfo else t)
    if isinstance(x, int) or "int" in type(x).__name__:
        return f"{float(x):.5g}" if abs(x) < 99999 else str(int(x))
    return str(x)


def canon(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted("|".join(map(text, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf, db):
    assert name in QUERIES
    assert canon(QUERIES[name](spark, sf).toPandas()) == canon(db.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.limit(5).collect() is not None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
