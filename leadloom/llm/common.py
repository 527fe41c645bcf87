"""Pieces that several operators share: patterns, running totals, components of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.session import freeze

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct ``_row``, so that no column of the input can clash with a new one."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def growing(df: DataFrame) -> DataFrame:
    """A join side whose rows grow with the corpus: never broadcast, however few they are now."""
    return df.hint("merge")


def crc32_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id written as decimal text; NULL stays NULL."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column | str],
                   name: str) -> DataFrame:
    """Adds, per entry of ``totals``, its sum over all rows up to and including this one.

    The rows are range-partitioned by ``order`` and frozen with their partition
    number, so a lost executor cannot move a row. Each partition then sums its own
    rows; only one row per partition is brought together to find where it starts.
    ``order`` should identify a row; rows equal in it may take each other's place.
    """
    cols = {k: F.col(c) if isinstance(c, str) else c for k, c in totals.items()}
    placed = df.select("*", *[c.alias(f"_add_{k}") for k, c in cols.items()])
    frozen = freeze(placed.repartitionByRange(*order)
                    .withColumn("_part", F.spark_partition_id()), name)
    parts = frozen.groupBy("_part").agg(*[F.sum(f"_add_{k}").alias(f"_sum_{k}") for k in cols])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", *[F.coalesce(F.sum(f"_sum_{k}").over(earlier), F.lit(0))
                                     .alias(f"_start_{k}") for k in cols])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = frozen.select(*df.columns, "_part",
                           *[F.sum(f"_add_{k}").over(own).alias(f"_own_{k}") for k in cols])
    return summed.join(starts, "_part").select(
        *df.columns, *[(F.col(f"_own_{k}") + F.col(f"_start_{k}")).alias(k) for k in cols])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node reachable.

    Alternates two steps until each component is a star around its root: every larger neighbour of a
    node is tied to the node's smallest neighbour, then every smaller one. Only minima are
    taken per node, so a node with very many links is summed before the shuffle.
    """
    state = freeze(edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                                F.least("a", "b").alias("b")).distinct(), name)
    while not _all_stars(state):
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        tied = large.join(least, "a").select("b", "a", "low")
        small = (tied.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .union(tied.select("a", F.col("low").alias("b"))).distinct())
        state = freeze(small, name)
    return (state.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end: what neither step changes any more."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(
        "up > 1 OR (up > 0 AND down > 0)").isEmpty()
