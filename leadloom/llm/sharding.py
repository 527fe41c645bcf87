"""Sharding along a Hilbert curve over document metadata.

Metadata dimensions are quantised to equal-mass levels (strings by their place among all
strings of the column, whatever their length or prefix), a row's place on the Hilbert curve
through those levels is its sort key, and the sorted rows are cut into runs of equal counts.
Neighbours on the curve are near in every dimension, so each shard (and each row group in
it) covers a small box and readers can skip files by any of the dimensions.

Defined results: a NULL in a dimension takes its lowest level; NULL text has size 1 and
crc 0; equal places are ordered by id, then size and crc, NULL ids first; repeated rows
each get their own slot; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import running_totals
from leadloom.session import freeze, lookup

BITS = 5
DIMENSIONS = ("lang", "source", "text")


def string_levels(rows: DataFrame, name: str, n: int, bits: int) -> DataFrame:
    """(``name``, _level) for each string in that column: how many of the ``n`` rows hold NULL or a string
    that sorts before it, in parts of 2**bits. Whole strings are compared, so a common prefix
    does not matter, and rows are counted per string before anything is sorted."""
    counted = rows.groupBy(name).agg(F.count("*").alias("_rows"))
    upto = running_totals(counted, [F.col(name).asc_nulls_first()], {"_upto": "_rows"}, "shard-levels")
    return upto.where(F.col(name).isNotNull()).select(
        name, F.expr(f"(_upto - _rows) * {1 << bits}L div {max(n, 1)}L").alias("_level"))


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2**bits.

    ``levels`` has one row per dimension. Axes are turned into the transposed index
    bit plane by bit plane (Skilling's method), then the planes are interleaved.
    """
    x = levels.astype(np.int64).copy()
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        below = (1 << plane) - 1
        for i in range(dims):
            is_set = (x[i] >> plane & 1).astype(bool)
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(is_set, below, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> plane & 1, (1 << plane) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> plane & 1)
    return out


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = BITS,
                   dimensions: tuple[str, ...] = DIMENSIONS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, ``carry``, curve, shard, slot: every row of ``docs`` placed.

    Dimensions are columns of ``docs``; ``text`` stands for its size in bytes. Only narrow
    rows are sorted unless ``carry`` asks for more. The levels' bounds, 2**bits - 1 numbers
    per dimension of numbers, are all that reaches the driver.
    """
    kinds = dict(docs.dtypes)
    strings = [d != "text" and kinds[d] == "string" for d in dimensions]

    def code(name: str, is_string: bool) -> Column:
        if name == "text":
            return F.octet_length("text").cast("double")
        return F.col(name) if is_string else F.col(name).cast("double")

    narrow = freeze(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).alias("text_crc32"),
        *[c for c in carry if c not in ("doc_id", "size", "text_crc32")],
        *[code(d, s).alias(f"_dim{i}") for i, (d, s) in enumerate(zip(dimensions, strings, strict=True))]),
        "shard-rows")
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = narrow.agg(F.count("*").alias("n"), *[
        F.percentile_approx(f"_dim{i}", cuts, 10000).alias(f"c{i}")
        for i, s in enumerate(strings) if not s]).first()
    bounds = [None if s else np.array(row[f"c{i}"] or [], dtype=float) for i, s in enumerate(strings)]
    levelled = narrow
    for i, s in enumerate(strings):
        if s:
            levels = string_levels(narrow, f"_dim{i}", row["n"], bits)
            levelled = lookup(levelled, levels, [f"_dim{i}"], spread=["doc_id", "text_crc32"]).withColumn(
                f"_dim{i}", F.coalesce("_level", F.lit(0))).drop("_level")

    @F.pandas_udf("long")
    def curve(*cols: pd.Series) -> pd.Series:
        levels = [c.to_numpy() if b is None else
                  np.where(np.isnan(c.to_numpy(dtype=float)), 0,
                           np.searchsorted(b, c.to_numpy(dtype=float), "right"))
                  for c, b in zip(cols, bounds, strict=True)]
        return pd.Series(hilbert_index(np.array(levels), bits))

    order = ["curve", "doc_id", "size", "text_crc32"]
    placed = levelled.withColumn("curve", curve(*[f"_dim{i}" for i in range(len(dimensions))])).drop(
        *[f"_dim{i}" for i in range(len(dimensions))])
    ranked = running_totals(placed, [F.col(c).asc_nulls_first() for c in order],
                            {"_row": F.lit(1).cast("long")}, "shard-order")
    n = max(row["n"], 1)
    return ranked.select(
        "*", F.expr(f"int((_row - 1) * {shards}L div {n}L)").alias("shard")).select(
        "*", F.expr(f"_row - 1 - (shard * {n}L + {shards - 1}L) div {shards}L").alias("slot")).drop("_row")


def write_shards(docs: DataFrame, path: str, shards: int = 16, rows_per_file: int = 100_000) -> None:
    """Whole documents as Parquet, one folder per shard, files and row groups in curve order."""
    placed = hilbert_shards(docs, shards, carry=tuple(docs.columns))
    file = F.floor(F.col("slot") / rows_per_file)
    (placed.withColumn("_file", file).repartition("shard", "_file")
     .sortWithinPartitions("shard", "slot").drop("_file", "size", "text_crc32", "curve")
     .write.partitionBy("shard").parquet(path))
