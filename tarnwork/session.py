"""Session settings and the shared folder for lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tarnwork", cpus: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings the operators expect (UTC, adaptive execution)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for data that later stages read: what spark.checkpoint.dir names.

    Where it is unset a temporary one is made, but only by a session on a single machine (tests);
    on a cluster, where executors would not find it, that is an error.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or (held.get() if held.isDefined() else None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _folders.get(sc.applicationId) or _folders.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and written to the shared folder."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table of the shared folder, for data that several queries read."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_built: dict[tuple[str, str], tuple[DataFrame, ...]] = {}


def _stands(df: DataFrame) -> bool:
    """Whether the files of a written table are still there."""
    sc = df.sparkSession.sparkContext
    paths = [sc._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return all(p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p) for p in paths)


def once(spark: SparkSession, name: str, build: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """The written tables that build gives, built by the first caller of the session, and anew if their files are gone; for stored indexes that later queries read."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _built or not all(map(_stands, _built[key])):
        _built[key] = build()
    return _built[key]


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once a session, so that it need not be installed on them."""
    sc = spark.sparkContext
    if getattr(sc, "_tarnwork_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "tarnwork.zip"  # on the driver, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(here.rglob("*.py")):
            z.write(file, file.relative_to(here.parent))
    sc.addPyFile(str(archive))
    sc._tarnwork_shipped = True


def spread(scan: DataFrame) -> DataFrame:
    """A scan before heavy work per row, over all cores: repartitioned only if it would fill less than half of them.

    One small file is one task; a large table has tasks enough and is left as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() * 2 >= cores else scan.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
