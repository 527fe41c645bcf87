"""Hard negatives: against all pairs, over several blocks, and where the scan stops."""

import math
import random

import numpy as np
import pytest

from leadloom.llm import hardneg as H

SCHEMA = "vec_id long, embedding array<float>, label int, score long, key string, v string, rank int, positives int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "k", "v", 1, 2) for r in rows], SCHEMA)


def brute(rows, every=50):
    seen, used = set(), []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = tuple(max(-H.LIMIT, min(H.LIMIT, math.floor(float(np.float32(c)) * 256))) for c in x)
        row = (i, (label + 1) % 10 if i % 7 == 0 else label, v)
        if row not in seen:
            seen.add(row)
            used.append(row)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for ai, al, av in (r for r in used if r[0] % every == 0):
        scored = sorted((-dot(av, v), i, label) for i, label, v in used)
        for ps, pi, _ in [s for s in scored if s[2] == al and s[1] != ai][:5]:
            window = [s for s in scored if s[2] != al and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(ai, pi, n, ni, -ps, -ns) for n, (ns, ni, _) in enumerate(window, 1)]
    return sorted(out)


def got(df, **kw):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in names) for r in H.hard_negatives(df, **kw).collect())


def vectors(seed, n, dims=16, spread=1.0, labels=10):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.1, spread) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


def test_random_vectors_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS_PER_BLOCK", 150)
    monkeypatch.setattr(H, "ANCHORS_PER_BLOCK", 3)
    rows = vectors(1, 700)
    assert got(table(spark, rows).repartition(3)) == brute(rows) != []


def test_copies_and_ties(spark, monkeypatch):
    rows = vectors(2, 300, dims=3, spread=0.02, labels=3)
    same = rows[17][1]
    rows += [(1000 + i, same, i % 4) for i in range(200)] + [(2000 + i, [0.0, 0.0, 0.0], i % 2) for i in range(60)]
    want = brute(rows)
    assert got(table(spark, rows)) == want != []
    monkeypatch.setattr(H, "ROWS_PER_BLOCK", 40)
    assert got(table(spark, rows)) == want


def test_rows_that_take_no_part_and_repeats(spark):
    rows = vectors(3, 200, dims=4, labels=2)
    inf, nan = float("inf"), float("nan")
    odd = [(None, [1.0] * 4, 1), (100, None, 1), (301, [1.0, None, 1.0, 1.0], 1), (302, [nan] * 4, 1), (303, [-inf] * 4, 0),
           (304, [1.0] * 4, None), (50, rows[50][1], rows[50][2]), (51, rows[51][1], rows[51][2]), (350, [9e30, -9e30, 0.0, 1.0], 1)]
    assert got(table(spark, rows + odd)) == brute(rows + odd) != []


def test_short_vectors_zeros_and_negative_ids(spark):
    rows = [(-50, [1.0, 2.0], 1), (0, [0.0, 0.0], 9), (50, [], 1), (1, [1.0], 1), (2, [0.0, 1.0, 5.0], 1), (3, [1.0, 0.5], 2),
            (4, [0.0, 1.0], 2), (5, [], 2), (-7, [0.5, 0.5], 1), (6, [0.0, 0.0, 1.0], 0)]
    padded = [(i, x + [0.0] * (3 - len(x)), label) for i, x, label in rows]
    assert got(table(spark, rows)) == brute(padded) != []


def test_nothing(spark):
    assert got(table(spark, [])) == []
    assert got(table(spark, [(1, [1.0], 1)])) == []  # no anchor
    assert got(table(spark, [(50, [1.0], 1), (51, [1.0], 2)])) == []  # no positive


@pytest.mark.parametrize("top", [20, 3_000_000])
def test_scan_stops_early_and_loses_nothing(top):
    rng = np.random.default_rng(5)
    values = rng.integers(-top, top, (4000, 3)).astype(float)
    lists, anchor, k = H.Lists(values), np.array([7.0, -3.0, 0.0]), 5
    reads = []

    def done(scores, met, threshold):
        reads.append(int(met.sum()))
        return threshold < H._kth(scores, np.flatnonzero(met), k)

    scores, met = lists.scan(anchor, done)
    best = H._best(scores, np.arange(4000), np.flatnonzero(met), k)
    assert best.tolist() == sorted(range(4000), key=lambda i: (-(values[i] @ anchor), i))[:k]
    assert reads[-1] < 4000


def test_window_scan_reads_to_the_lower_end():
    values = np.arange(1000, dtype=float).reshape(-1, 1)
    scores, met = H.Lists(values).scan(np.array([2.0]), lambda s, m, t: t < 1500)
    assert met[750:].all() and not met.all()
