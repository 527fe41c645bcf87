"""Latest-per-key, caps, top-k, pages, numbering and running offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.session import freeze


def latest_per_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """The row with the greatest ``order_cols`` per key, as a combining aggregate."""
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    last = df.groupBy(*keys).agg(F.max(F.struct(*order_cols, *rest)).alias("_r"))
    return last.select(*keys, "_r.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """The row with the least ``order_cols`` per key, as a combining aggregate."""
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order_cols, *rest)).alias("_r"))
    return first.select(*keys, "_r.*").select(*df.columns)


def cap_per_group(df: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows per group.

    The filter on ``row_number`` lets Spark cut every group to ``n`` rows before
    the shuffle as well (``WindowGroupLimit``).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def topk(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def ranked(df: DataFrame, order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows with their rank. Numbering sees only those ``k`` rows."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    return topk(df, order, k).withColumn(rank, F.row_number().over(w))


def sponsors_ranked(companies: DataFrame) -> DataFrame:
    return companies.where("h1b_confirmed").orderBy(F.col("lca_count").desc(), F.col("name"))


def page(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    return topk(df, order, n)


def number_rows(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Consecutive numbers from 1 in the order of ``order``, without one big task.

    Rows are range-partitioned and sorted, frozen in the shared folder so that the
    partition numbers cannot change on a retry, and every partition then adds the
    number of rows before it. Only one row per partition is brought together.
    ``order`` must identify a row.
    """
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))
    frozen = freeze(placed, "numbered")
    part = F.shiftright(F.col("_at"), 33)
    counts = frozen.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return (frozen.withColumn("_part", part).join(offsets, "_part")
            .withColumn(name, F.col("_base") + local + 1).drop("_part", "_base", "_at"))


def append_with_ids(old: DataFrame, rows: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Old rows, then the new rows numbered on from the greatest existing id."""
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint").alias("_top"))
    numbered = number_rows(rows.drop(id_col), order, "_no").select(
        "*", top.scalar().alias("_top"))
    fresh = numbered.withColumn(id_col, F.col("_top") + F.col("_no")).drop("_no", "_top")
    return old.unionByName(fresh.select(*old.columns))


def fill_ids(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Give the rows whose id is NULL the next ids (after an upsert)."""
    return append_with_ids(df.where(F.col(id_col).isNotNull()),
                           df.where(F.col(id_col).isNull()), id_col, order)


def running_offset(df: DataFrame, key: str, order: str, size: str,
                   name: str = "offset") -> DataFrame:
    """Sum of ``size`` over the earlier rows of the same key.

    A large key is spread by range over several partitions. Each partition sums
    its own part; only one row per (key, partition) is then summed per key.
    """
    placed = (df.repartitionByRange(key, order).sortWithinPartitions(key, order)
              .withColumn("_part", F.spark_partition_id()))
    frozen = freeze(placed, "offsets")
    local = Window.partitionBy(key, "_part").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    sums = frozen.groupBy(key, "_part").agg(F.sum(size).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(key, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = frozen.withColumn("_local", F.coalesce(F.sum(size).over(local), F.lit(0)))
    # as many rows as there are keys, however well their file packs: never broadcast
    return (within.join(bases.hint("merge"), [key, "_part"])
            .withColumn(name, (F.col("_base") + F.col("_local")).cast("bigint"))
            .drop("_part", "_base", "_local"))


def distribute_bullets(entries: DataFrame, bullets: DataFrame, key: str,
                       pos: str = "pos") -> DataFrame:
    """Hand out new bullets to entries in order, each as many as it had before.

    ``entries``: key, pos, ``bullets`` (array); ``bullets``: one row per key with
    the array ``new_bullets``. An entry that gets none keeps its own. Entries and
    bullets meet on (key, slot number), which is unique on both sides. The planner knows the
    size of the bullets only before they are exploded, so that join is planned as a shuffle.
    """
    sized = entries.withColumn("_size", F.size("bullets"))
    placed = running_offset(sized, key, pos, "_size")
    slots = placed.where(F.col("_size") > 0).select(
        key, pos, F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("_size") - 1))
        .alias("_slot"))
    fresh = bullets.select(key, F.posexplode("new_bullets").alias("_at", "_text")).select(
        key, F.col("_at").cast("bigint").alias("_slot"), "_text")
    given = (slots.join(fresh.hint("merge"), [key, "_slot"]).groupBy(key, pos)
             .agg(F.array_sort(F.collect_list(F.struct("_slot", "_text"))).alias("_given")))
    joined = placed.drop("_size", "offset").join(given, [key, pos], "left")
    return joined.withColumn(
        "bullets", F.coalesce(F.col("_given._text"), F.col("bullets"))).select(*entries.columns)
