"""Small document tables with the awkward rows every operator must handle."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, "
           "_id long, size string, key string, score double, _hash string, source_size int, node string, value int")


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def documents(spark, rows):
    """rows: (doc_id, text, source); every other column is filled with values that may mislead."""
    full = [(i, t, "en" if k % 3 else None, s, None if t is None else len(t), 7, "big", "k", 0.5, "h", 3, "n", 1)
            for k, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


LONG = prose(99, 60_000)
SHARED = prose(5, 40)
MESSY = [(1, "", "a"), (2, None, "a"), (None, prose(1, 30), None), (3, LONG, "b"), (4, SHARED, "a"),
         (4, SHARED, "a"), (5, SHARED, "c"), (6, " \t\n ", None), (7, SHARED.upper(), "a"),
         (8, prose(8, 25), "b"), (9, "one", "b"), (10, "one", "b")]


def messy(spark):
    return documents(spark, MESSY).repartition(3)


def empty(spark):
    return documents(spark, [])


def labels(spark, pairs, name):
    return spark.createDataFrame([(i, v) for i, v in pairs], f"doc_id long, {name} int").withColumn(
        "score", F.lit(1)).withColumn("text", F.lit("not the text"))
