"""Listing ingest at a cost that follows what arrives.

Each micro-batch is linked to the sponsors, folded to one row per URL and logged. The table
carries a mark: version n holds the batches before n. A refresh reads the last version and the
batches from its mark on, merges them in one pass over buckets (``sources.keyed``) and so moves
the mark; no batch is folded into the table twice, and batches below the mark are not listed
by any later read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.functions.text import blank
from leadloom.operators.link import substring_link
from leadloom.operators.merge import fold_job_folds, fold_jobs, merge_job_folds
from leadloom.session import delete_paths, freeze, list_dirs, scratch_scope
from leadloom.sources.keyed import KeyedTable


class ListingStore:
    """The listing table, the log of linked and folded batches, and the stream's checkpoint, below ``base``."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 64, nullif_empty: bool = False):
        self.spark, self.base, self.nullif_empty = spark, base.rstrip("/"), nullif_empty
        self.table = KeyedTable(spark, f"{self.base}/table", "jd_url", buckets)

    def create(self, jobs: DataFrame) -> None:
        """Start from a listing table whose URLs are unique."""
        self.table.create(jobs)

    def _batch(self, batch_id: int) -> str:
        return f"{self.base}/log/batch={batch_id:09d}"

    def ingest(self, stream: DataFrame, sponsors: DataFrame, seq: list[str],
               spread: list[str] | None = None) -> StreamingQuery:
        """Take what has arrived: the sponsor link as a join of the batch with the static ``sponsors`` (name), then
        the fold in the order ``seq``. A replayed batch overwrites its own folder."""
        def take(batch: DataFrame, batch_id: int) -> None:
            with scratch_scope(self.spark):
                rows = freeze(batch.where(~blank("jd_url")), "arrived")
                linked = substring_link(rows, sponsors, "company", "name", spread=spread)
                fold_jobs(linked, seq, self.nullif_empty).write.mode("overwrite").parquet(self._batch(batch_id))

        return (stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{self.base}/checkpoint")
                .trigger(availableNow=True).start())

    def _pending(self, mark: int) -> list[int]:
        found = [int(d.split("=")[1]) for d in list_dirs(self.spark, f"{self.base}/log")]
        return [n for n in found if n >= mark]

    def pending(self) -> DataFrame | None:
        """Folds of the batches that the last version does not hold, one row per URL; None if there are none."""
        batches = self._pending(self.table.latest())
        if not batches:
            return None
        log = self.spark.read.option("basePath", f"{self.base}/log").parquet(*map(self._batch, batches))
        return fold_job_folds(log, ["batch"])

    def current(self, asof: dt.datetime | str) -> DataFrame:
        """The table as a refresh now would leave it, without storing it."""
        old, waiting = self.table.read(), self.pending()
        if waiting is None:
            return old
        return merge_job_folds(old, freeze(waiting, "pending"), asof, self.table.buckets, self.nullif_empty)

    def refresh(self, asof: dt.datetime | str) -> int:
        """Merge the pending batches into the next version; the version that is then the last."""
        version = self.table.latest()
        batches = self._pending(version)
        if not batches:
            return version
        with scratch_scope(self.spark):
            self.table.write(self.current(asof), batches[-1] + 1)
        return batches[-1] + 1

    def trim(self, keep: int = 2) -> int:
        """Delete old versions, and the logged batches that the oldest version left already holds."""
        gone = self.table.forget(keep)
        mark = self.table.versions()[0]
        done = [int(d.split("=")[1]) for d in list_dirs(self.spark, f"{self.base}/log")]
        return gone + delete_paths(self.spark, [self._batch(n) for n in done if n < mark])


def arrivals(stream: DataFrame) -> DataFrame:
    """The stream with ``arrived``, the time its file was written, for use in ``seq``."""
    return stream.withColumn("arrived", F.col("_metadata.file_modification_time"))
