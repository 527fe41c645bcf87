"""Decontamination: against every window of every document."""

import re
from collections import Counter

import pytest
from fixtures import MESSY, documents, empty, messy, prose
from pyspark.sql import functions as F

from leadloom.llm import decontam

ITEMS = [(0, prose(50, 14)), (1, prose(51, 60)), (2, prose(52, 33)), (3, None), (4, "  "), (5, "Rare, words!"),
         (1, prose(51, 60)), (6, "one")]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def brute(rows, items, least=0.8):
    out = {}
    for i, t, _ in rows:
        w = words(t)
        for item, text in items:
            q = words(text)
            if not w or not q:
                continue
            for at in range(max(len(w) - len(q), 0) + 1):
                a, b = shingles(w[at:at + len(q)]), shingles(q)
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= least - 1e-12 and s > out.get((i, item), (0, 0))[0]:
                    out[i, item] = (s, at)
    return out


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumn("length", F.lit("x"))


def rows_of(df):
    return {(r.doc_id, r.item_id): (pytest.approx(r.similarity), r.start) for r in df.collect()}


def cases():
    p = [prose(50, 14), prose(51, 60), prose(52, 33)]
    changed = p[1].split()
    changed[30] = "other"
    rows = [(100, f"{prose(60, 50)} {p[0]} {prose(61, 10)}", "s"),
            (101, p[1].upper().replace(" ", ", "), "s"),
            (102, f"{prose(62, 7)} {' '.join(changed)}. {prose(63, 70)}", "s"),
            (103, " ".join(p[2].split()[:31]), "s"),
            (104, " ".join(p[1].split()[:40]) + " " + prose(64, 40), "s"),
            (105, f"{p[0]} {p[1]} {p[2]} {p[0]}", "s"),
            (106, "Some rare words here", "s"), (107, prose(65, 300), "s")]
    rows += [(200 + i, f"{prose(300 + i, 20)} {p[2]} {prose(400 + i, 20)}", "hot") for i in range(60)]
    return rows


def test_against_all_windows(spark):
    rows = cases()
    got = rows_of(decontam.leaks(documents(spark, rows).repartition(4), table(spark, ITEMS)))
    want = brute(rows, ITEMS)
    assert got == want
    assert (102, 1) in want and (103, 2) in want and (104, 1) not in want


def test_documents_without_leaks_stay(spark):
    rows = cases() + MESSY
    docs = documents(spark, rows)
    leaked = {i for i, _ in brute(rows, ITEMS)}
    out = decontam.without_leaks(docs, table(spark, ITEMS))
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _, _ in rows if i not in leaked)


def test_messy_and_empty(spark):
    assert rows_of(decontam.leaks(messy(spark), table(spark, ITEMS))) == brute(MESSY, ITEMS)
    assert decontam.leaks(empty(spark), table(spark, ITEMS)).collect() == []
    none = table(spark, [(0, None)])
    assert decontam.leaks(messy(spark), none).collect() == []
    assert decontam.without_leaks(messy(spark), none.limit(0)).count() == len(MESSY)


@pytest.mark.parametrize("longest", [10, 1000, 100_000])
def test_simhash_lanes_agree(spark, longest):
    row = spark.range(1).select(F.split(F.lit("a b c d e f a a g"), " ").alias("w")).select(
        F.expr(decontam.simhash("w", longest)).alias("h"), F.transform("w", lambda x: F.xxhash64(x)).alias("x")).first()
    want = sum((2 * sum(v >> b & 1 for v in row.x) > 9) << b for b in range(64))
    assert row.h & (2**64 - 1) == want
