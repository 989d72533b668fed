"""Tables kept as full Parquet snapshots behind a pointer file."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tarnwork.operators.indexing import upsert


class SnapshotTable:
    """A folder of snapshots on a shared file system; the pointer names the current one.

    A write makes a whole new snapshot and then swaps the pointer, so readers see the old or
    the new state, never a part.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        os.makedirs(folder, exist_ok=True)

    @property
    def pointer(self) -> str:
        return os.path.join(self.folder, "CURRENT")

    def exists(self) -> bool:
        return os.path.exists(self.pointer)

    def read(self) -> DataFrame:
        with open(self.pointer) as f:
            return self.spark.read.option("mergeSchema", True).parquet(os.path.join(self.folder, f.read().strip()))

    def write(self, rows: DataFrame, partition_by: list[str] | None = None) -> None:
        name = f"snapshot-{uuid.uuid4().hex}"
        writer = rows.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(os.path.join(self.folder, name))
        with open(self.pointer + ".new", "w") as f:
            f.write(name)
        os.replace(self.pointer + ".new", self.pointer)

    def upsert(self, rows: DataFrame, key: list[str]) -> None:
        """Rows with a known key are replaced, others added."""
        self.write(upsert(self.read(), rows, key) if self.exists() else rows)
