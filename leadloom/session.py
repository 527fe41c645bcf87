"""Session set-up and the few helpers that depend on where a job runs."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 8


def build_session(app: str = "leadloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="leadloom-")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster it
    would not be visible to the other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not (spark.conf.get("spark.master", "") or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return _local_dir()


_scratch: set[str] = set()
_scope: ContextVar[list[str] | None] = ContextVar("_scope", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, kept until :func:`drop_scratch`."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.add(path)
    if _scope.get() is not None:
        _scope.get().append(path)
    return path


def delete_paths(spark: SparkSession, paths: Iterable[str]) -> int:
    """Delete folders through the file system they are on; how many there were."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        dropped += bool(place.getFileSystem(conf).delete(place, True))
        _scratch.discard(path)
    return dropped


def drop_scratch(spark: SparkSession) -> int:
    """Delete every intermediate table of this driver; call it when results are written.

    Results that were not written yet can no longer be computed after it.
    """
    return delete_paths(spark, sorted(_scratch))


@contextmanager
def scratch_scope(spark: SparkSession):
    """Intermediate tables that this thread writes inside are deleted at the end.

    For jobs that also write their result inside, such as a micro-batch.
    """
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        delete_paths(spark, paths)


@contextmanager
def small_partitions(spark: SparkSession, size: str = "4m"):
    """For jobs that run inside and sort narrow rows: shuffle partitions are joined up to ``size`` only. Ids and flags
    compress so well that the usual 64 MB of shuffle unfold to several GB of one task's memory."""
    key, to_bytes = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark._jvm.org.apache.spark.network.util.JavaUtils
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(to_bytes.byteStringAsBytes(before), to_bytes.byteStringAsBytes(size))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def listed_in_tasks(spark: SparkSession, tasks: int):
    """For a scan of very many folders that is set up inside: they are listed by at most ``tasks`` tasks of
    many folders each. By default every folder is a task of its own, up to 10,000."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), tasks)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def listed_on_driver(spark: SparkSession, max_files: int):
    """For a file stream in batches of ``max_files`` that starts and ends inside: a batch looks up its files
    on the driver instead of in a job with a task per file. A source asks its session at every batch."""
    key = "spark.sql.sources.parallelPartitionDiscovery.threshold"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), max_files)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def small_files(spark: SparkSession, size: str = "1m"):
    """For scans of very many small files that run inside: a file counts as ``size`` more than it has (by default 4 MB),
    so that a task takes more of them."""
    key, to_bytes = "spark.sql.files.openCostInBytes", spark._jvm.org.apache.spark.network.util.JavaUtils
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(to_bytes.byteStringAsBytes(before), to_bytes.byteStringAsBytes(size))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder on a local or mounted file system; None in any other store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    return place.getPath() if place.getScheme() == "file" else None


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``; none if it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory())


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so later branches see the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def instant(value: dt.datetime | str, dtype: T.DataType | None = None) -> Column:
    """A timestamp literal of the wanted type, so a filter on it is pushed down."""
    name = "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else "timestamp"
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else str(value)
    return F.lit(text).cast(name)


def parse_instant(value: dt.datetime | str) -> dt.datetime:
    return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value)


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
           spread: list[str] | None = None, salts: int = SALTS) -> DataFrame:
    """Join ``left`` to ``right``, whose rows are unique on ``on``.

    ``spread`` names left columns that vary within a hot key. The left rows of
    one key are then split over ``salts`` hash partitions and the (smaller)
    right side is repeated that often; the result does not change. Catalyst
    still broadcasts the right side when its measured size is below the limit.
    """
    if not spread or salts < 2:
        return left.join(right, on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
