"""Dashboard counts kept up to date from what a mutation changed.

A count over a table is a sum of ones, so a mutation moves it by the ones of the rows as they are
after it less the ones of the same rows before it. Only the changed rows are read, found by the ids
of the delta; the table itself is counted once, at the start. Every step is a partition of
its own with one row per count that moved: a step that runs again overwrites itself and nothing
is counted twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import small_partitions

Metrics = dict[str, dict[str, Column]]


def funnel_metrics() -> Metrics:
    """Per table the condition of every count of ``reports.funnel_stats``."""
    status = F.col("applied_status")
    return {"jobs": {"total_jobs": F.lit(True), "h1b_jobs": F.col("h1b_confirmed"), "applied": status == "applied",
                     "interviews": status == "interview"},
            "outreach": {"emails_sent": F.col("status") == "sent"}}


def dashboard_metrics() -> Metrics:
    """Per table the condition of every count of ``reports.dashboard_stats``."""
    status, mail = F.col("applied_status"), F.col("status")
    return {"jobs": {"total": F.lit(True), "h1b": F.col("h1b_confirmed"),
                     "pending": (status == "pending") & F.col("h1b_confirmed"), "applied": status == "applied"},
            "outreach": {"emails": mail == "sent", "drafts": mail == "draft"},
            "contacts": {"contacts": F.lit(True)}}


def touched(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The stored rows that a delta names; the mutation of these alone gives the rows after it."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def _counts(rows: DataFrame, metrics: dict[str, Column], sign: Column | int) -> DataFrame:
    """metric, n: the signed number of rows that meet each condition, in one pass."""
    one = rows.agg(*[F.coalesce(F.sum(F.when(c, sign)), F.lit(0)).cast("bigint").alias(m) for m, c in metrics.items()])
    return one.unpivot([], list(metrics), "metric", "n")


def signed_counts(before: DataFrame, after: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """metric, n: by how much each count moved; counts that did not are left out."""
    both = before.withColumn("_sign", F.lit(-1)).unionByName(after.withColumn("_sign", F.lit(1)))
    return _counts(both, metrics, F.col("_sign")).where("n <> 0")


def signed_groups(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: by how much the rows of each group moved (``reports.status_counts`` from a delta)."""
    both = before.select(*keys, F.lit(-1).alias("_sign")).unionByName(after.select(*keys, F.lit(1).alias("_sign")))
    return both.groupBy(*keys).agg(F.sum("_sign").alias("n")).where("n <> 0")


def add_groups(stored: DataFrame, moved: DataFrame, keys: list[str]) -> DataFrame:
    """Stored group counts after a move; groups that are empty then are left out."""
    return stored.select(*keys, "n").unionByName(moved.select(*keys, "n")).groupBy(*keys).agg(
        F.sum("n").alias("n")).where("n <> 0")


class MaintainedCounts:
    """The counts of ``metrics`` below ``base``: a start and one small partition per step since."""

    def __init__(self, spark: SparkSession, base: str, metrics: Metrics):
        self.spark, self.base, self.metrics = spark, base.rstrip("/"), metrics

    def _put(self, rows: DataFrame, step: int) -> None:
        with small_partitions(self.spark):
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/step={step}")

    def start(self, tables: dict[str, DataFrame]) -> None:
        """Count every table in full, once."""
        parts = [_counts(tables[t], m, F.lit(1)) for t, m in self.metrics.items()]
        self._put(reduce(DataFrame.unionByName, parts), 0)

    def apply(self, step: int, table: str, before: DataFrame, after: DataFrame) -> None:
        """Note how the rows of one mutation moved the counts; ``step`` (from 1) names the mutation."""
        if step < 1:
            raise ValueError("step 0 is the start")
        self._put(signed_counts(before, after, self.metrics[table]), step)

    def current(self) -> DataFrame:
        """One row with a column per count."""
        rows = self.spark.read.schema("metric string, n bigint, step int").parquet(self.base)
        names = [m for part in self.metrics.values() for m in part]
        return rows.agg(*[F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("n"))), F.lit(0)).cast("bigint").alias(m)
                          for m in names])
