"""What each filter removes in every order of the filters, from one pass over the corpus.

A document is reduced to its mask, one bit per filter that it fails. For each mask (and label
pair) there is one wide integer with a field for every counter of every step of every
order: 5! orders x 5 steps = 600 steps, six counters each. The audit of a part is the sum
of its documents' integers. Since equal masks have equal integers, rows are first counted
per (part, mask, labels) by a combining aggregate, at most 4 x 2^filters rows a part, and
an integer is multiplied by its count. Fields are 64 bits wide and a count is below
2^63, so no field can reach its neighbour.

Defined results: NULL text is empty text, NULL source is the part ''; a document is good (toxic)
if any label row of its id says 1; rows with a NULL id have no labels and never fail filter E;
rows that repeat an id and text are counted each and don't fail E by one another;
no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import SPACE, growing

LETTERS = "ABCDE"
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_WS = " \t\n\x0b\x0c\r"


def _bits(*fails: Column) -> Column:
    bit = F.lit(0)
    for k, f in enumerate(fails):
        bit = bit + F.when(f, F.lit(1 << k)).otherwise(F.lit(0))
    return bit


def text_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask of the filters A to D, which look at a text alone."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("_text"),
                      F.split(F.btrim(text, F.lit(_WS)), SPACE, -1).alias("_words"))
    some = F.element_at("_words", 1) != ""
    counted = cut.select(
        "doc_id", "part", "_text", F.when(some, F.size("_words")).otherwise(0).alias("_n"),
        F.when(some, F.size(F.array_distinct("_words"))).otherwise(0).alias("_distinct"))
    capitals = F.regexp_count("_text", F.lit("[A-Z]"))
    return counted.select(
        "doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"),
        _bits(F.col("_n") < 50, F.col("_distinct") * 100 < F.col("_n") * 65,
              capitals.cast("bigint") * 100 > F.char_length("_text").cast("bigint") * 5,
              F.col("_text").rlike("[#$%&*|]")).alias("mask"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic: one row per document.

    Filter E: the first row of equal texts is found per digest by a combining minimum. Rows meet it
    on (digest, id), not on the digest, so a text with very many copies is spread.
    """
    rows = text_masks(docs)
    firsts = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    marked = rows.join(growing(firsts.withColumn("_first", F.lit(True))), ["digest", "doc_id"], "left")
    told = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # rows without an id would all meet in one task
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("bigint"))
    both = marked.withColumn("_spread", spread).join(
        growing(told.withColumn("_spread", F.lit(0).cast("bigint"))), ["doc_id", "_spread"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    return both.select("part", (F.col("mask") + F.when(copy, F.lit(16)).otherwise(F.lit(0))).alias("mask"),
                       F.coalesce("good", F.lit(False)).alias("good"),
                       F.coalesce("toxic", F.lit(False)).alias("toxic"))


@cache
def _orders(letters: str) -> tuple[tuple[int, ...], ...]:
    return tuple(permutations(range(len(letters))))


@cache
def wide_counter(mask: int, good: bool, toxic: bool, letters: str) -> int:
    """The integer of one document: 64-bit fields in the order (filter order, step, counter)."""
    fields = np.zeros((len(_orders(letters)), len(letters), len(COUNTERS)), dtype="<u8")
    for o, order in enumerate(_orders(letters)):
        gone = False
        for s, f in enumerate(order):
            fails = bool(mask >> f & 1)
            removed = fails and not gone
            fields[o, s] = (not gone and not fails, removed, fails and gone, mask == 1 << f,
                            removed and good, removed and toxic)
            gone = gone or fails
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int, letters: str) -> np.ndarray:
    """Counters by (filter order, step, counter) of a sum of wide counters."""
    shape = (len(_orders(letters)), len(letters), len(COUNTERS))
    return np.frombuffer(total.to_bytes(8 * int(np.prod(shape)), "little"), dtype="<u8").reshape(shape)


def audit(masked: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, the counters and shapley, from part, mask, good, toxic.

    Bit k of the mask stands for the k-th letter. ``shapley`` is what the step's filter removes,
    summed over all orders.
    """
    counts = masked.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(int(n) * wide_counter(int(m), bool(g), bool(t), letters)
                    for m, g, t, n in zip(rows["mask"], rows["good"], rows["toxic"], rows["n"], strict=True))
        fields = unpacked(total, letters)
        orders = np.array(_orders(letters))
        removed = fields[:, :, COUNTERS.index("removed")]
        share = np.array([removed[orders == f].sum() for f in range(len(letters))], dtype=np.int64)
        n, k = orders.shape
        out = {"part": [rows["part"].iloc[0]] * (n * k),
               "filter_order": ["".join(letters[f] for f in order) for order in orders for _ in range(k)],
               "step": np.tile(np.arange(1, k + 1, dtype=np.int32), n)}
        out |= {c: fields[:, :, i].ravel().astype(np.int64) for i, c in enumerate(COUNTERS)}
        return pd.DataFrame(out | {"shapley": share[orders].ravel()})

    kind = ("part string, filter_order string, step int, "
            + ", ".join(f"{c} long" for c in (*COUNTERS, "shapley")))
    return counts.groupBy("part").applyInPandas(summed, kind)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`audit` of the filters A (few words), B (repeated words), C (capitals), D (signs), E (copies)."""
    return audit(masks(docs, labels))
