"""Continuous listing ingest, follow-up release and the daily digest.

What a scheduled batch did becomes a stream here. Each job is a file stream run
with ``availableNow``: a schedule calls it, it takes what has arrived, and stops.
State lives in the checkpoint and in the written tables, so a lost executor or a
restarted driver repeats at most one micro-batch, whose output is overwritten.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leadloom.functions.text import title_label
from leadloom.operators.merge import merge_jobs
from leadloom.operators.outreach import due_followups, with_contact
from leadloom.functions.text import blank


def file_stream(spark: SparkSession, path: str, schema: T.StructType,
                max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _run_name(checkpoint: str) -> str:
    """A name for the run that owns a checkpoint; batch numbers are unique within it."""
    return hashlib.sha1(checkpoint.encode()).hexdigest()[:16]


def _batch_path(base: str, checkpoint: str, batch_id: int) -> str:
    return f"{base}/run={_run_name(checkpoint)}/batch_id={batch_id}"


def stream_ingest(stream: DataFrame, log_dir: str, checkpoint: str,
                  arrived_at: dt.datetime | str) -> StreamingQuery:
    """Append every micro-batch of scraped listings to a delta log.

    A batch is one directory that a replay overwrites. The log keeps every
    arrival: dropping repeated URLs in the stream would keep the first arrival
    and lose the later description. The upsert is the fold in
    :func:`ingested_jobs`, so a batch costs what arrived, not the table size.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("arrived_at", F.lit(str(arrived_at)))
         .write.mode("overwrite").parquet(_batch_path(log_dir, checkpoint, batch_id)))

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def ingested_jobs(old: DataFrame, log_dir: str, asof: dt.datetime | str,
                  seq: list[str], nullif_empty: bool = False) -> DataFrame:
    """The listing table after all logged batches, in batch order, then ``seq``."""
    log = old.sparkSession.read.option("basePath", log_dir).parquet(log_dir)
    return merge_jobs(old, log, asof, ["arrived_at", "batch_id", *seq], nullif_empty)


def read_ledger(spark: SparkSession, ledger_dir: str) -> DataFrame:
    """Released drafts; empty before the first release."""
    from leadloom.sources.tables import path_exists

    schema = "id bigint, job_id bigint, to_email string, sent_at string"
    if not path_exists(spark, ledger_dir):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(ledger_dir)


def release_followups(stream: DataFrame, jobs: DataFrame, contacts: DataFrame, day: int,
                      ledger_dir: str, checkpoint: str,
                      asof: dt.datetime | str) -> StreamingQuery:
    """Release the drafts due on ``day`` that have an address, once.

    Released ids go to a ledger. A draft that is in the ledger of another batch
    is not due any more, so a second run, even with a new checkpoint, adds none.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        target = _batch_path(ledger_dir, checkpoint, batch_id)
        run = f"run={_run_name(checkpoint)}/batch_id={batch_id}/"
        earlier = read_ledger(spark, ledger_dir).where(
            ~F.contains(F.input_file_name(), F.lit(run))).select("id")
        due = with_contact(due_followups(batch, jobs, day), contacts).where(~blank("to_email"))
        rows = due.join(earlier, "id", "left_anti").groupBy("id").agg(
            F.min(F.struct("job_id", "to_email")).alias("_r"))
        (rows.select("id", "_r.*", F.lit(str(asof)).alias("sent_at"))
         .write.mode("overwrite").parquet(target))

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def as_utc_instant(c: str):
    """A zone-less timestamp read as UTC, whatever the session time zone is."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(c)).cast("timestamp")


def utc_day(c):
    """The UTC date of an instant."""
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"),
                                        c.cast("timestamp_ntz")))


def stream_digest(stream: DataFrame, watermark: str = "1 hour",
                  ts: str = "created_at") -> DataFrame:
    """Event counts per UTC day and type. A day is emitted once the watermark has
    passed its end; rows that arrive later are dropped. ``ts`` is a timestamp."""
    counts = (stream.withWatermark(ts, watermark)
              .groupBy(F.window(ts, "1 day").alias("w"), "event").agg(F.count("*").alias("n")))
    return counts.select(utc_day(F.col("w.start")).alias("day"),
                         title_label("event").alias("label"), "event", "n")


def run_digest(digest: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    return (digest.writeStream.format("parquet").outputMode("append")
            .option("path", out_dir).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
