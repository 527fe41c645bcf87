"""Near dedup: against all pairs on small tables, for both shingle widths."""

from collections import Counter

import pytest
from fixtures import MESSY, documents, empty, messy, prose

from leadloom.llm import neardup


def brute(rows, width, percent=80):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + width]) for k in range(max(len(w) - width + 1, 1))) if w else frozenset())
    at = list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                at[root(a)] = root(b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        r = root(k)
        low[r] = i if low.get(r) is None else min(low[r], i) if i is not None else low[r]
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = low[root(k)]
        out.append((i, len(sets[k]), c, i == c))
    return Counter(out)


def rows_of(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def near_copies(n, seed=3, words=200, changes=4):
    import random
    rng, base = random.Random(seed), prose(seed, words).split()
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
        rows.append((500 + i, " ".join(w), "hot"))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(spark, width):
    rows = [(i, prose(i % 60, 20 + i % 30), "s") for i in range(120)] + near_copies(80)
    # a chain: each document is linked only with the next
    chain = prose(77, 120).split()
    rows += [(300 + k, " ".join(chain[6 * k:6 * k + 60]), "s") for k in range(9)]
    assert rows_of(neardup.near_groups(documents(spark, rows).repartition(4), width)) == brute(rows, width)


def test_crowded_buckets_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "SMALL", 2)
    rows = near_copies(60, seed=8, words=60, changes=12) + [(i, prose(i, 40), "s") for i in range(10)]
    assert rows_of(neardup.near_groups(documents(spark, rows), 2)) == brute(rows, 2)


def test_chain_in_one_bucket(spark):
    # with two bands of one value most texts share buckets, so pairs of several components meet
    rows = near_copies(40, seed=1, words=60, changes=9) + near_copies(40, seed=1, words=66, changes=9)
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    got = neardup.near_groups(documents(spark, rows), 2, bands=24, rows=1)
    assert rows_of(got) == brute(rows, 2)


def test_messy_rows(spark):
    assert rows_of(neardup.near_groups(messy(spark), 2)) == brute(MESSY, 2)


def test_empty(spark):
    assert neardup.near_groups(empty(spark)).collect() == []
    assert neardup.one_of_each(empty(spark)).collect() == []


def test_one_of_each_keeps_columns_and_one_row(spark):
    docs = messy(spark)
    out = neardup.one_of_each(docs)
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({1: 1, 2: 1, None: 1, 3: 1, 4: 1, 6: 1, 8: 1, 9: 1})


def test_signature_estimates_similarity():
    """Share of equal values of two signatures against the exact similarity."""
    import numpy as np

    from leadloom.llm.textbuf import mix
    rng = np.random.default_rng(0)
    both = mix(rng.integers(0, 2**63, 800).astype(np.uint64))
    a, b = both[:600], both[200:]
    h = np.concatenate([a, b])
    keys = neardup.band_keys(h, np.array([0, 600, 1200]), 4000, 1)
    assert abs((keys[0] == keys[1]).mean() - 0.5) < 0.05
