"""The ledger of released follow-ups, partitioned so that a batch reads only what can concern it.

Layout: followup_day / bucket of the draft's id / batch. A batch of drafts of one day reads the
ids of the buckets its own drafts fall into, and never those of other days; all three columns
are partition columns, so the rest is pruned before any file is opened. A batch writes partitions
of its own, which a replay overwrites. Compaction turns the many small files of a
bucket into one; new files are complete before old ones go, and a row that is there twice is
the same as once.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.functions.text import blank
from leadloom.operators.outreach import due_followups, with_contact
from leadloom.session import delete_paths, freeze, list_dirs, scratch_scope
from leadloom.sources.tables import path_exists

SCHEMA = "id bigint, job_id bigint, to_email string, sent_at string, followup_day int, bucket int, batch string"
PARTS = ("followup_day", "bucket", "batch")


class ReleaseLedger:
    def __init__(self, spark: SparkSession, base: str, buckets: int = 16):
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets

    def bucket(self, key: str = "id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        """All stored rows; a draft can be there twice after a compaction that was cut short."""
        if not path_exists(self.spark, self.base):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.base)

    def released(self) -> DataFrame:
        """One row per released draft."""
        first = self.rows().groupBy("id").agg(F.min(F.struct("sent_at", "job_id", "to_email", "followup_day")).alias("_r"))
        return first.select("id", "_r.job_id", "_r.to_email", "_r.sent_at", "_r.followup_day")

    def known(self, day: int, buckets: list[int], but: str = "") -> DataFrame:
        """Ids released for a day in some buckets, without those of one batch."""
        return self.rows().where((F.col("followup_day") == day) & F.col("bucket").isin(buckets)
                                 & (F.col("batch") != but)).select("bucket", "id")

    def _write(self, rows: DataFrame) -> None:
        (rows.repartition("followup_day", "bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(self.base))

    def release(self, stream: DataFrame, jobs: DataFrame, contacts: DataFrame, day: int, checkpoint: str,
                asof: dt.datetime | str) -> StreamingQuery:
        """Release the drafts due on ``day`` that have an address, each once over all batches and runs."""
        run = hashlib.sha1(checkpoint.encode()).hexdigest()[:16]

        def take(batch: DataFrame, batch_id: int) -> None:
            own = f"{run}-{batch_id}"
            with scratch_scope(self.spark):
                due = with_contact(due_followups(batch, jobs, day), contacts).where(~blank("to_email"))
                folded = due.groupBy("id").agg(F.min(F.struct("job_id", "to_email")).alias("_r"))
                rows = freeze(folded.select("id", "_r.*", F.lit(str(asof)).alias("sent_at"),
                                            F.lit(day).alias("followup_day"), self.bucket().alias("bucket"),
                                            F.lit(own).alias("batch")), "due")
                touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
                if touched:
                    new = rows.join(self.known(day, touched, own), ["bucket", "id"], "left_anti")
                    self._write(freeze(new, "released"))

        return (stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())

    def batches(self) -> dict[str, list[str]]:
        """Batch folders by followup_day/bucket folder."""
        days = [d for d in list_dirs(self.spark, self.base) if d.startswith("followup_day=")]
        parts = [f"{d}/{b}" for d in days for b in list_dirs(self.spark, f"{self.base}/{d}")]
        return {p: list_dirs(self.spark, f"{self.base}/{p}") for p in parts}

    def compact(self, least: int = 2) -> int:
        """One file for every bucket of at least ``least`` batches; how many batch folders went. Not beside a release."""
        crowded = {p: names for p, names in self.batches().items() if len(names) >= least}
        if not crowded:
            return 0
        old = [f"{self.base}/{p}/{n}" for p, names in crowded.items() for n in names]
        with scratch_scope(self.spark):
            stored = self.spark.read.schema(SCHEMA).option("basePath", self.base).parquet(*old)
            once = stored.groupBy("followup_day", "bucket", "id").agg(
                F.min(F.struct("sent_at", "job_id", "to_email")).alias("_r"))
            self._write(freeze(once.select("id", "_r.job_id", "_r.to_email", "_r.sent_at", "followup_day", "bucket",
                                           F.lit(f"merged-{uuid.uuid4().hex}").alias("batch")), "compacted"))
        return delete_paths(self.spark, old)
