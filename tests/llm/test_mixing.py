"""Mixing: against a plain water-filling and a queue simulated row by row."""

import re
from collections import Counter, defaultdict

import pytest
from fixtures import MESSY, documents, empty, messy, prose

from leadloom.llm import mixing


def plain_targets(sizes, weights, limit=3):
    total, out, open_ = float(sum(sizes.values())), {}, set(sizes)
    while open_:
        w = sum(weights[s] for s in open_)
        full = [s for s in open_ if total * weights[s] / w > limit * sizes[s]]
        if not full:
            out.update({s: total * weights[s] / w for s in open_})
            break
        for s in full:
            out[s] = limit * sizes[s]
            total -= out[s]
            open_.discard(s)
    return out


def check(rows, got):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    want = plain_targets(sizes, weights)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    assert sorted(r["size"] for r in got) == sorted(size)
    assert sum(taken.values()) <= sum(size)


def test_targets_and_words(spark):
    rows = [(i, prose(i, 5 + i % 40), f"s{i % 7}" if i % 11 else "hot") for i in range(400)]
    rows += [(1000 + i, prose(i, 30), "hot") for i in range(300)]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    check(rows, got)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)


def test_messy_rows(spark):
    got = mixing.mix(messy(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in MESSY)
    check(MESSY, got)
    assert all(r["size"] == 0 and r.taken == 0 for r in got if r.doc_id in (1, 2, 6))


def test_empty(spark):
    assert mixing.mix(empty(spark)).collect() == []
    assert mixing.mixed_documents(empty(spark)).collect() == []
    only_empty = documents(spark, [(1, "", "a"), (2, None, "b")])
    assert [r.taken for r in mixing.mix(only_empty).collect()] == [0, 0]


def test_documents_come_as_often_as_taken(spark):
    docs = messy(spark)
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r.doc_id, r["size"]] += r.copies
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, len((r.text or "").split())) for r in out.collect())
    assert got == Counter({k: v for k, v in plan.items() if v})
