"""The filter audit: every order applied filter by filter to every document, and the packed fields."""

import re
from collections import defaultdict
from itertools import permutations

from fixtures import MESSY, documents, empty, labels, messy
from pyspark.sql import functions as F

from leadloom.llm import filteraudit as A


def brute(rows, quality, toxic):
    """Each order is played through on the documents that are left."""
    lows = {}
    for i, t, _ in rows:
        if i is not None:
            lows[t or ""] = min(lows.get(t or "", i), i)
    facts = []
    for i, t, s in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {x for x, f in (("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
                                ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)),
                                ("D", re.search(r"[#$%&*|]", text)),
                                ("E", i is not None and i > lows[text])) if f}
        facts.append((s or "", fails, (i, 1) in quality, (i, 1) in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        by_filter = defaultdict(int)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                cut = [f for f in left if x in f[1]]
                n = len([f for f in mine if x in f[1]])
                out[part, "".join(order), step] = [
                    len(left) - len(cut), len(cut), n - len(cut), len([f for f in mine if f[1] == {x}]),
                    sum(f[2] for f in cut), sum(f[3] for f in cut)]
                by_filter[x] += len(cut)
                left = [f for f in left if x not in f[1]]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(by_filter[order[step - 1]])
    return out


def got(frame):
    return {(r.part, r.filter_order, r.step): [r[c] for c in (*A.COUNTERS, "shapley")] for r in frame.collect()}


HARD = [(30 + i, text, s) for i, (text, s) in enumerate([
    ("a b c", "x"), ("a b c", "y"), ("Word " * 60, "x"), (" ".join(f"w{i}" for i in range(60)), "x"),
    (" ".join(f"w{i}" for i in range(60)) + " $", "x"), (" ".join(f"W{i}" for i in range(60)), "y"),
    ("ABC", "x"), ("ABC", "x"), ("é|é", None), ("", "x"), (None, "x"), (" " * 5, "x"), ("word Word " * 40, "y"),
    (" ".join(["a"] * 49), "y"), ("\x0b".join(f"v{i % 33}" for i in range(50)), "y")])]
HARD += [(None, "a b c", "x"), (None, "ABC", "y"), (30, "a b c", "x"), (30, "a b c", "y"), (31, "ABC", "x")]


def pair(spark, quality, toxic):
    q, t = labels(spark, quality, "quality"), labels(spark, toxic, "toxic")
    return q.withColumn("toxic", F.lit(None).cast("int")).unionByName(
        t.withColumn("quality", F.lit(None).cast("int")))


def test_all_orders_of_messy_and_hard_rows(spark):
    quality, toxic = [(30, 1), (30, 0), (33, 1), (4, 1), (4, 1), (None, 1), (35, 0)], [(32, 1), (44, 1), (999, 1), (8, 0)]
    told = pair(spark, quality, toxic)
    for rows, docs in ((MESSY, messy(spark)), (HARD, documents(spark, HARD).repartition(3))):
        assert got(A.filter_audit(docs, told)) == brute(rows, set(quality) - {(None, 1)}, set(toxic))


def test_empty(spark):
    assert got(A.filter_audit(empty(spark), pair(spark, [(1, 1)], []))) == {}


def test_without_labels(spark):
    assert got(A.filter_audit(messy(spark), pair(spark, [], []).where("false"))) == brute(MESSY, set(), set())


def test_fields_do_not_reach_their_neighbours():
    n = (1 << 62) + 12345
    for mask in (0, 1, 21, 31):
        one = A.unpacked(A.wide_counter(mask, True, True, "ABCDE"), "ABCDE")
        many = A.unpacked(n * A.wide_counter(mask, True, True, "ABCDE"), "ABCDE")
        assert one.shape == (120, 5, 6) and set(one.ravel().tolist()) <= {0, 1}
        assert (many == one * many.dtype.type(n)).all()


def test_other_filters(spark):
    rows = spark.createDataFrame([("p", 1, False, False), ("p", 3, True, False), ("p", 0, False, True)],
                                 "part string, mask int, good boolean, toxic boolean")
    res = got(A.audit(rows, "XY"))
    assert res["p", "XY", 1] == [1, 2, 0, 1, 1, 0, 3] and res["p", "YX", 2] == [1, 1, 1, 1, 0, 0, 3]


def test_copies_meet_on_text_and_id(spark):
    rows = [(i, "copy of one text " * 20, "hot") for i in range(500)]
    res = got(A.filter_audit(documents(spark, rows).repartition(7), pair(spark, [], [])))
    assert res["hot", "EABCD", 1][:2] == [1, 499]
