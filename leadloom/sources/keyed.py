"""Tables stored by key: every version is bucketed and sorted by the column it is merged on.

A merge then joins the stored side as it lies on disk, whatever the size of the delta: only
the delta is shuffled, into as many partitions as there are buckets, and every task writes one bucket
of the next version. A version is a folder of its own and counts once it is complete, so a
job that dies half way loses nothing and is simply run again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from leadloom.session import delete_paths, list_dirs
from leadloom.sources.tables import path_exists


class KeyedTable:
    """Versions 0, 1, 2, … of one table below ``base``."""

    def __init__(self, spark: SparkSession, base: str, key: str, buckets: int = 64):
        self.spark, self.base, self.key, self.buckets = spark, base.rstrip("/"), key, buckets

    def path(self, version: int) -> str:
        return f"{self.base}/version={version:09d}"

    def _name(self, version: int) -> str:
        return "keyed_" + hashlib.sha1(self.path(version).encode()).hexdigest()[:20]

    def versions(self) -> list[int]:
        """The complete versions, oldest first."""
        found = [int(d.split("=")[1]) for d in list_dirs(self.spark, self.base) if d.startswith("version=")]
        return [n for n in found if path_exists(self.spark, f"{self.path(n)}/_SUCCESS")]

    def latest(self) -> int:
        found = self.versions()
        if not found:
            raise ValueError(f"no complete version below {self.base}")
        return found[-1]

    def write(self, df: DataFrame, version: int) -> None:
        """Store ``df`` as a version; an unfinished attempt at it is replaced.

        The result of a merge with a stored version already lies by key, one task per bucket. Any other
        table is dealt so first, else every task would write a file for every bucket.
        """
        (df.write.mode("overwrite").format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
         .option("path", self.path(version)).saveAsTable(self._name(version)))

    def create(self, df: DataFrame) -> None:
        """Store ``df`` as version 0."""
        self.write(df.repartition(self.buckets, self.key), 0)

    def read(self, version: int | None = None) -> DataFrame:
        """A version with its layout known to the planner, in this and any later session."""
        version = self.latest() if version is None else version
        name = self._name(version)
        if not self.spark.catalog.tableExists(name):
            path = self.path(version)
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) "
                           f"SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def forget(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` complete versions."""
        old = self.versions()[:-keep]
        for version in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(version)}")
        return delete_paths(self.spark, [self.path(v) for v in old])
