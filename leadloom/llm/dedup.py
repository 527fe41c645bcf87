"""Exact duplicates by a stateful stream.

A stream over the documents' digests keeps one record per digest in a disk-backed state
store (RocksDB) that never expires: the digest, the identifier of the row that stays and
where that row's content is (locator), with a count. Rows are combined before they reach
the state, so a digest with very many rows sends one record per task. Where a digest was
hit more than once the full bytes are compared with the content found by the locator;
rows that differ in spite of an equal digest are grouped again by their bytes.

Defined results: NULL and empty text are the same text; of equal texts the row with the
most code points, then the smallest doc_id stays (NULL ids last, and they never stay if
there is another); repeated rows with one id all count, and all are kept if their id is;
no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import SPACE
from leadloom.session import freeze, list_dirs, scratch_path

STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # many small stores: no space reserved ahead, and only changes are uploaded at a commit
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(col: str = "text") -> Column:
    """The text without ASCII white space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def _setting(spark: SparkSession, values: dict[str, str]):
    """Settings a stream copies when it starts, put back at once after."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stream_groups(spark: SparkSession, digests: str, schema: T.StructType, state: str, out: str,
                  files_per_batch: int | None = None, trace: list[dict] | None = None) -> DataFrame:
    """Streams the folder ``digests`` through the state; digest, group_size, keep_id, n_points, file.

    Called again with the same ``state`` and ``out`` after files were added, it goes on from
    the stored state: earlier documents are still known, however long ago they came.
    """
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("first"), "file"))
    groups = source.parquet(digests).groupBy("digest").agg(
        F.count("*").alias("group_size"), best.alias("best"))

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    with _setting(spark, STORE):
        query = (groups.writeStream.outputMode("update").foreachBatch(keep)
                 .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    if trace is not None:
        trace += [json.loads(p.json) for p in query.recentProgress]
    kind = T.StructType([*groups.schema.fields, T.StructField("epoch", T.LongType())])
    seen = (spark.read.schema(kind).parquet(out) if list_dirs(spark, out)
            else spark.createDataFrame([], kind))
    last = seen.groupBy("digest").agg(F.max(F.struct("epoch", "group_size", "best")).alias("last"))
    return last.select("digest", F.col("last.group_size").alias("group_size"),
                       F.bitwise_not("last.best.first").alias("keep_id"),
                       F.col("last.best.n_points").alias("keep_points"),
                       F.col("last.best.file").alias("keep_file"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256,
                 waves: int = 2, trace: list[dict] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    The documents reach the stream in ``waves`` batches, spread by a hash of their id, so
    equal texts meet in the stored state and not only within one batch. The result is the same for
    every number of waves. ``trace`` gets the stream's progress reports.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "dedup-digests")
    docs.select("doc_id", digest(normalised()).alias("digest"), sha256(normalised()).alias("text_sha256"),
                F.coalesce(F.length("text"), F.lit(0)).alias("n_points"),
                F.input_file_name().alias("file"),
                F.pmod(F.xxhash64("doc_id"), F.lit(waves)).alias("wave")).write.partitionBy("wave").parquet(folder)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("digest", T.StringType()),
        T.StructField("text_sha256", T.StringType()), T.StructField("n_points", T.IntegerType()),
        T.StructField("file", T.StringType())])
    digests = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    files = max(1, -(-len(digests.inputFiles()) // waves))
    groups = freeze(stream_groups(spark, folder, schema, scratch_path(spark, "dedup-state"),
                                  scratch_path(spark, "dedup-groups"), files, trace), "dedup-last")
    placed = digests.join(groups, "digest")
    result = ["doc_id", "keep_id", "group_size",
              F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]

    hits = placed.where("group_size > 1").select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "keep_id", "keep_points",
        "keep_file").distinct()
    held = freeze(
        docs.select("doc_id", "text", F.input_file_name().alias("_file"))
        .join(hits, F.col("doc_id").eqNullSafe(F.col("_id")))
        .select("doc_id", "_file", "keep_id", "keep_points", "keep_file", "_digest",
                normalised().alias("_bytes"), F.coalesce(F.length("text"), F.lit(0)).alias("n_points"))
        .where(digest(F.col("_bytes")) == F.col("_digest")), "dedup-hits")
    located = (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
               & (F.col("_file") == F.col("keep_file")))
    retained = held.where(located).groupBy("_digest").agg(F.any_value("_bytes").alias("_kept_bytes"))
    differ = held.join(retained, "_digest").where("_bytes <> _kept_bytes")
    if differ.isEmpty():
        return placed.select(*result)

    clashes = freeze(differ.select("_digest").distinct(), "dedup-clashes")
    apart = held.join(clashes, "_digest", "left_semi")
    own = apart.groupBy("_digest", "_bytes").agg(
        F.count("*").alias("group_size"),
        F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("first"))).alias("best"))
    own = own.select("_digest", F.col("_bytes").alias("_b"), "group_size",
                     F.bitwise_not("best.first").alias("keep_id"))
    again = (apart.drop("keep_id").join(own.withColumnRenamed("_digest", "_d"),
                                        (F.col("_digest") == F.col("_d")) & (F.col("_bytes") == F.col("_b")))
             .withColumn("text_sha256", sha256(F.col("_bytes"))))
    rest = placed.join(clashes, placed["digest"] == clashes["_digest"], "left_anti")
    return rest.select(*result).unionByName(again.select(*result))
