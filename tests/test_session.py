import shutil

import pytest

from tarnwork.session import once, shared_folder, written
from tests.conftest import rows


def test_stored_tables_are_built_once_and_again_if_they_are_gone(spark):
    built = []

    def build():
        built.append(1)
        return (written(spark.range(len(built))),)

    assert rows(once(spark, "t", build)[0]) == rows(once(spark, "t", build)[0]) == [(0,)] and len(built) == 1
    for f in once(spark, "t", build)[0].inputFiles():
        shutil.rmtree(f.removeprefix("file://").rpartition("/")[0], ignore_errors=True)
    assert rows(once(spark, "t", build)[0]) == [(0,), (1,)] and len(built) == 2


def test_the_shared_folder_stays_the_same_and_is_required_on_clusters(spark, monkeypatch):
    assert shared_folder(spark) == shared_folder(spark)

    class Context:
        master, applicationId = "spark://host:7077", "app"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": lambda self, k, d: d})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
