"""Compiled catalogs kept as folders of Parquet tables, the newest read back."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

KEEP = 10


class SnapshotStore:
    """Snapshots under ``path``; one is visible once its ``_DONE`` mark is written."""

    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """Complete snapshots, oldest first."""
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(n for n in found if self._fs.exists(self._path(f"{self.path}/{n}/_DONE")))

    def save(self, tables: dict[str, DataFrame]) -> str:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        for k, df in tables.items():
            df.write.parquet(f"{self.path}/{name}/{k}")
        self._fs.create(self._path(f"{self.path}/{name}/_DONE"), True).close()
        for old in self.names()[: -self.keep]:
            self._fs.delete(self._path(f"{self.path}/{old}"), True)
        return name

    def newest(self) -> dict[str, DataFrame]:
        """Tables of the newest snapshot; an empty store has none."""
        names = self.names()
        if not names:
            return {}
        tables = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{names[-1]}")) if s.isDirectory()]
        return {t: self.spark.read.parquet(f"{self.path}/{names[-1]}/{t}") for t in tables}
