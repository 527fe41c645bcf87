"""Line dedup: against a dictionary of whole lines, runs over partition borders, and the bitmaps."""

import random
from collections import defaultdict

import numpy as np
import pytest
from fixtures import MESSY, documents, empty, messy
from pyspark.sql import functions as F

from leadloom.llm import linededup as L

WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    key = lambda line: line.strip(WS).translate(LOWER)
    order = lambda i: (i is None, i or 0)
    first, out = {}, []
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                first[k] = min(first.get(k, (True, 1)), order(i))
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        stays = [len(key(x)) < 10 or first[key(x)] == order(i) for x in lines]
        out.append((i, len(lines), stays.count(False), "\n".join(x for x, s in zip(lines, stays) if s)))
    return sorted(out, key=str)


def got(docs):
    return sorted([tuple(r) for r in L.dedup_lines(docs).collect()], key=str)


TRICKY = [(20, "Same Line Here\n  same line here\t\nother", "s"), (21, "\x0bSAME LINE HERE\r\nshort\nshort", "s"),
          (22, "short\n\n\nÄPFEL UND BIRNEN\n", "s"), (23, "äpfel und birnen\nÄpfel und Birnen\nÄpfel UND BIRNEN", "s"),
          (24, "nine char\nten chars!", "s"), (25, "nine char\nten chars!", "s"), (None, "ten chars!\nTen Chars!", "s"),
          (None, "only without id\nonly without id", "s"), (None, "only without id", "t"),
          (-3, "zwölf Zeichen\U0001f600", "s"), (-2, "zwölf Zeichen\U0001f600\n" * 3, "s"), (26, "\n", "s"),
          (27, "same id, two texts\nx", "s"), (27, "same id, two texts\ny", "s"), (27, "same line here", "s")]


def test_messy_and_tricky_rows(spark):
    assert got(messy(spark)) == brute(MESSY)
    assert got(documents(spark, TRICKY).repartition(4)) == brute(TRICKY)


def test_empty(spark):
    assert got(empty(spark)) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_a_hot_line_runs_over_partition_borders(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["the very common line", f"line number {rng.randrange(300)}", "tiny", ""])
                          for _ in range(rng.randrange(1, 40))), "s") for i in range(400)]
    rows += [(1000, "the very common line\n" * 3000, "s"), (-1, "the very common line\n" * 5, "s")]
    docs = documents(spark, rows).repartition(5)
    assert got(docs) == brute(rows)
    hashes = L.line_hashes(docs)
    hot = hashes.groupBy("a", "b").count().agg(F.max("count")).first()[0]
    order = ["a", "b", "id_missing", "id", "text_key", "pos"]
    dealt = hashes.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < hot / 2  # the common line was split


def test_bitmaps(spark):
    rng = random.Random(4)
    for n in (1, 7, 8, 9, 70_000):
        gone = np.array(sorted(rng.sample(range(n), max(1, n // 3))))
        keep = np.ones(n, dtype=bool)
        keep[gone] = False
        assert (L.unpack(L.pack(gone), n) == keep).all()
    docs = documents(spark, [(1, "a common line", "s"), (2, "x\na common line\n" + "own words here\n" * 40_000, "s")])
    maps = L.keep_bitmaps(docs).collect()
    assert [(r.doc_id, r.n_dropped) for r in maps] == [(2, 1)] and len(maps[0].keep) < 100


def test_stream_over_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert got(documents(spark, TRICKY).coalesce(1)) == brute(TRICKY)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_copies_of_one_text(spark):
    rows = [(i, "first line of it\nsecond line of it", "s") for i in range(300)]
    want = defaultdict(int)
    for _, _, dropped, _ in got(documents(spark, rows).repartition(6)):
        want[dropped] += 1
    assert dict(want) == {0: 1, 2: 299}
