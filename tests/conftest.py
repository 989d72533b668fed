import pytest

from tarnwork.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cpus="4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def rows(df, *columns):
    """The rows as sorted tuples."""
    got = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in got), key=str)
