"""Table, text, metadata and parameter scans, and versioned table writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom import schemas
from leadloom.functions.text import strip_ws


def read_table(spark: SparkSession, base: str, name: str,
               version: str | None = None) -> DataFrame:
    """Scan one table with its declared schema (no inference pass)."""
    path = f"{base}/{name}" + (f"/{version}" if version else "")
    return spark.read.schema(schemas.TABLES[name]).parquet(path)


def write_version(df: DataFrame, base: str, name: str, version: str,
                  partition_by: list[str] | None = None) -> str:
    """Store a new version of a table in a directory of its own.

    The old version is never touched, so a job that dies half way loses nothing.
    """
    path = f"{base}/{name}/{version}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop_path.getFileSystem(conf).exists(hadoop_path)


def load_profile(spark: SparkSession, path: str, default: DataFrame) -> DataFrame:
    """Whole-file text as one ``profile`` row, or ``default`` if there is no file."""
    if not path_exists(spark, path):
        return default
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("profile"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Every ``metadata.json`` below ``path``; folders without one are skipped."""
    return (spark.read.schema(schemas.METADATA)
            .option("pathGlobFilter", "metadata.json").option("recursiveFileLookup", "true")
            .option("multiLine", "true").json(path))


def _parsed_metadata(texts: DataFrame) -> DataFrame:
    kind = T.StructType([*schemas.METADATA.fields, T.StructField("_bad", T.StringType())])
    record = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # a file that is no JSON object or of another kind throughout is damaged as well
    some = F.coalesce(*[F.col(f"_m.{f.name}").cast("string") for f in schemas.METADATA.fields])
    rows = texts.select(record.alias("_m"), F.col("_metadata.file_path").alias("file"))
    return rows.select(*[F.col(f"_m.{f.name}").alias(f.name) for f in schemas.METADATA.fields], "file",
                       (F.col("_m").isNull() | F.col("_m._bad").isNotNull() | some.isNull()).alias("damaged"))


FILES_A_TASK, BYTES_A_TASK = 128, 16 << 20


def _tasks_for(texts: DataFrame) -> int:
    """How many tasks a scan of small files takes, of about 128 files or 16 MB each. Spark counts 4 MB more for every
    file than it has, which makes a task of a few files already."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, len(texts._jdf.inputFiles()) // FILES_A_TASK, size // BYTES_A_TASK)


def _folder(reader, path: str, pattern: str) -> DataFrame:
    return (reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
            .option("ignoreMissingFiles", "true").text(path, wholetext=True))


def scan_metadata(spark: SparkSession, path: str, pattern: str = "metadata.json") -> DataFrame:
    """Every metadata file below ``path`` with its ``file`` and whether it is ``damaged``.

    One bad file doesn't stop a scan over very many: what can be read of it is kept and marked. Files that
    vanish between the listing and the read are skipped, as are empty files and folders without one. Reading is Spark's,
    so any store it can reach will do; only the fields that are used are parsed.
    """
    texts = _folder(spark.read, path, pattern)
    return _parsed_metadata(texts).coalesce(_tasks_for(texts))


def stream_metadata(spark: SparkSession, path: str, pattern: str = "metadata.json",
                    max_files: int | None = None) -> DataFrame:
    """:func:`scan_metadata` as a stream: each file once, when it arrives."""
    reader = spark.readStream
    return _parsed_metadata(_folder(reader.option("maxFilesPerTrigger", max_files) if max_files else reader, path, pattern))


def read_metadata_lines(spark: SparkSession, path: str) -> DataFrame:
    """Metadata written by :func:`leadloom.sources.sinks.write_metadata`."""
    return spark.read.schema(schemas.METADATA).json(path)


def parse_ids(spark: SparkSession, text: str) -> DataFrame:
    """``"1, 2,,3"`` as a one-column table of ids; blanks are dropped."""
    parts = F.transform(F.split(F.lit(text), ",", -1), strip_ws)
    ids = F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.cast("bigint"))
    return spark.range(1).select(F.explode(ids).alias("id"))


def select_by_ids(df: DataFrame, text: str, key: str = "id") -> DataFrame:
    """The rows whose key is in the list. The list is a program argument, so it is small."""
    ids = parse_ids(df.sparkSession, text).select(F.col("id").alias(key)).distinct()
    return df.join(ids, key, "left_semi")


def migrate_schema(df: DataFrame, target: T.StructType = schemas.JOBS,
                   defaults: dict | None = None) -> DataFrame:
    """Add the columns that are missing; existing columns and extra ones stay."""
    values = schemas.JOBS_ADDED_DEFAULTS if defaults is None else defaults
    added = {f.name: F.lit(values.get(f.name)).cast(f.dataType)
             for f in target.fields if f.name not in df.columns}
    return df.withColumns(added) if added else df


def union_sources(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; a column missing from one source is NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def write_by_day(df: DataFrame, path: str, ts: str = "created_at") -> str:
    """Store an event table partitioned by ``day``; a day with very many events becomes several files."""
    dated = df.withColumn("day", F.to_date(ts))
    dated.repartitionByRange("day", ts).write.mode("overwrite").partitionBy("day").parquet(path)
    return path


def read_by_day(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table of :func:`write_by_day`; filters on ``day`` are settled before a file is opened."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField("day", T.DateType())]))
    return reader.parquet(path)
