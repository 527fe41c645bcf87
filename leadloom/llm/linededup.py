"""Repeated lines: a line that many documents hold stays in the first of them only.

Only hashes of lines are shuffled. They are range-partitioned by (line, document, position) and
sorted, so a line that a third of all documents hold is spread over as many partitions as its
share asks for. Each task streams its part once and compares a row with the first document
of its run; nothing is gathered. What a run that crosses a partition border needs from the
partitions before is one row per partition. The result is one compressed bitmap per
document (bit 1: the line stays), not text; :func:`kept_texts` applies it.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. Two
keys count as equal if 128 bits of three hash functions agree.

Defined results: NULL and empty text are one empty line; keys shorter than ``min_points`` code
points always stay; rows with one doc_id are one document, so lines that only they share stay
in all of them; a NULL doc_id comes after every other and all NULLs are one document; equal rows
get equal results; no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import growing
from leadloom.session import freeze

MIN_POINTS = 10
_WS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a task reports: lines that go, lines that go if their document is not the first of a run
#: that began in an earlier partition, and the first and last run of the partition.
GONE, OPEN, SPAN = 0, 1, 2
_REPORT = ("kind int, part int, id_missing boolean, id long, text_key long, pos int, "
           "first_a long, first_b long, last_a long, last_b long")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _ascii_lower(text: Column) -> Column:
    """A-Z to a-z only; texts of one-byte characters take the quicker way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER))


def line_hashes(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """a, b (hash of the key), id_missing, id, text_key, pos: one row per line that can repeat."""
    lines = docs.select("doc_id", F.xxhash64(_text()).alias("text_key"),
                        F.posexplode(F.split(_ascii_lower(_text()), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_key", "pos", F.btrim("line", F.lit(_WS)).alias("key")).where(
        F.char_length("key") >= min_points)
    return keyed.select(
        F.xxhash64("key").alias("a"),
        F.shiftleft(F.hash("key").cast("bigint"), 32).bitwiseOR(F.crc32(F.col("key").cast("binary"))).alias("b"),
        F.col("doc_id").isNull().alias("id_missing"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("id"),
        "text_key", "pos")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted partition: which lines are not in the first document of their run."""
    from pyspark import TaskContext

    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("id_missing", pa.bool_()),
                        *[(n, pa.int64()) for n in ("id", "text_key")], ("pos", pa.int32()),
                        *[(n, pa.int64()) for n in ("first_a", "first_b", "last_a", "last_b")]])
    part = TaskContext.get().partitionId()
    head = run = None  # hash of the first run; (a, b, id_missing, id) where the current run began

    def report(kind, missing, ids, keys, pos, first, last):
        n = len(ids)
        full = lambda x: np.full(n, x)
        return pa.RecordBatch.from_arrays(
            [pa.array(full(kind), pa.int32()), pa.array(full(part), pa.int32()), pa.array(missing), pa.array(ids),
             pa.array(keys), pa.array(pos, pa.int32()), *[pa.array(full(x)) for x in (*first, *last)]], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, missing, ids, keys, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new[0] = run is None or (a[0], b[0]) != run[:2]
        head = head or (int(a[0]), int(b[0]))
        begin = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        at = np.maximum(begin, 0)
        lead_missing, lead = missing[at], ids[at]
        if run is not None:
            goes_on = begin < 0
            lead_missing = np.where(goes_on, run[2], lead_missing)
            lead = np.where(goes_on, run[3], lead)
        gone = (missing != lead_missing) | (ids != lead)
        unsure = ~gone & (a == head[0]) & (b == head[1])
        for kind, rows in ((GONE, gone), (OPEN, unsure)):
            if rows.any():
                yield report(kind, missing[rows], ids[rows], keys[rows], pos[rows], head, head)
        run = (int(a[-1]), int(b[-1]), bool(lead_missing[-1]), int(lead[-1]))
    if run is not None:
        yield report(SPAN, np.array([run[2]]), np.array([run[3]]), np.array([0]), np.array([0]), head, run[:2])


def repeated_lines(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """id_missing, id, text_key, pos of every line that goes."""
    order = ["a", "b", "id_missing", "id", "text_key", "pos"]
    placed = line_hashes(docs, min_points).repartitionByRange(*order).sortWithinPartitions(*order)
    told = freeze(placed.mapInArrow(_stream, _REPORT), "line-runs")
    ends = told.where(F.col("kind") == SPAN).groupBy(F.col("last_a").alias("first_a"),
                                                     F.col("last_b").alias("first_b")).agg(
        F.min(F.struct("part", "id_missing", "id")).alias("began"))
    late = told.where(F.col("kind") == OPEN).join(ends, ["first_a", "first_b"]).where(
        (F.col("began.part") < F.col("part"))
        & ((F.col("began.id_missing") != F.col("id_missing")) | (F.col("began.id") != F.col("id"))))
    columns = ["id_missing", "id", "text_key", "pos"]
    return told.where(F.col("kind") == GONE).select(*columns).unionByName(late.select(*columns))


def pack(gone: np.ndarray) -> bytes:
    """Positions that go as a compressed bitmap, lowest bit first; all bits past the end are 1 (kept)."""
    bits = np.ones((int(gone.max()) // 8 + 1) * 8 if len(gone) else 8, dtype=np.uint8)
    bits[gone] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    """For each of ``n_lines`` lines whether it stays."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little")[:n_lines]
    keep = np.ones(n_lines, dtype=bool)
    keep[:len(bits)] = bits == 1
    return keep


@F.pandas_udf(T.BinaryType())
def _bitmap(gone: pd.Series) -> pd.Series:
    return gone.map(lambda rows: pack(np.asarray(rows, dtype=np.int64)))


@F.pandas_udf(T.StringType())
def _apply(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def cut(t, b):
        if b is None:
            return None
        lines = t.split("\n")
        return "\n".join(line for line, stays in zip(lines, unpack(b, len(lines)), strict=True) if stays)

    return pd.Series([cut(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """doc_id, text_key, n_dropped, keep: one row per document that loses lines.

    ``text_key`` (xxhash64 of the text) tells rows of one doc_id apart.
    """
    rows = repeated_lines(docs, min_points).groupBy("id_missing", "id", "text_key").agg(
        F.collect_set("pos").alias("_gone"))
    return rows.select(F.when(~F.col("id_missing"), F.col("id")).alias("doc_id"), "text_key",
                       F.size("_gone").cast("bigint").alias("n_dropped"), _bitmap("_gone").alias("keep"))


def kept_texts(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: the text of every row without its repeated lines.

    Only texts that lose lines are handed to Python.
    """
    mine = docs.select("doc_id", _text().alias("text"), F.xxhash64(_text()).alias("text_key"))
    theirs = growing(bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_dropped", "keep"))
    both = mine.join(theirs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    cut = _apply(F.when(F.col("keep").isNotNull(), F.col("text")), "keep")
    return both.select("doc_id", F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"),
                       F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"),
                       F.coalesce(cut, "text").alias("kept"))


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """:func:`kept_texts` by the bitmaps of the same documents."""
    return kept_texts(docs, freeze(keep_bitmaps(docs, min_points), "line-bitmaps"))
