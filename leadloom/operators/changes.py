"""The change feed between two versions of a table, and its application.

Versions meet in one full outer join on the key; of the old one only the key and a hash of the row
take part. Two versions stored by the key (``sources.keyed``) meet without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def row_hash(columns: list[str]) -> Column:
    """128 bits of a row. Which columns are NULL is hashed too, for the hash functions skip NULLs."""
    cols = [F.col(f"`{c}`") for c in columns]
    missing = [c.isNull() for c in cols]
    return F.struct(F.xxhash64(*cols, *missing).alias("a"), F.xxhash64(*missing, *cols[::-1]).alias("b"))


def change_feed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """change (insert, update, delete) and the columns of ``new``; of a deleted row only the key is set.

    Both versions have the same columns and are unique on ``key``; rows without a key take no part.
    """
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError(f"columns differ: {sorted(set(old.columns) ^ set(new.columns))}")
    rest = [c for c in new.columns if c != key]
    before = old.where(F.col(key).isNotNull()).select(key, row_hash(rest).alias("_before"))
    after = new.where(F.col(key).isNotNull()).withColumn("_after", row_hash(rest))
    both = before.join(after, key, "full_outer")
    change = (F.when(F.col("_after").isNull(), F.lit(DELETE)).when(F.col("_before").isNull(), F.lit(INSERT))
              .when(F.col("_before") != F.col("_after"), F.lit(UPDATE)))
    return both.withColumn("change", change).where(F.col("change").isNotNull()).select("change", *new.columns)


def apply_feed(old: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """The next version: the old rows that the feed does not name, and its inserted and updated rows."""
    kept = old.join(feed.select(key), key, "left_anti")
    return kept.unionByName(feed.where(F.col("change") != DELETE).select(*old.columns))
