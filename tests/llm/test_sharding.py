"""Sharding: curve, law of the counts, and slots."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import MESSY, documents, empty, messy, prose

from leadloom.llm import sharding
from leadloom.session import scratch_path


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_in_unit_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims))).T
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(1 << bits * dims))
    path = cells[:, np.argsort(index)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def check(rows, got, shards):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_law_and_slots(spark):
    rows = [(i, prose(i, 1 + i % 90), f"s{i % 5}") for i in range(501)] + [(900 + i, "same", "hot") for i in range(300)]
    check(rows, sharding.hilbert_shards(documents(spark, rows).repartition(4)).collect(), 16)


def test_strings_with_a_long_common_prefix_keep_their_order(spark):
    names = [f"https://corpus.example.org/crawl/part-{k:02d}" for k in range(8)] + [None]
    rows = [(i, "t", names[i % 9]) for i in range(360)] + [(1000 + i, "t", names[3]) for i in range(180)]
    n = len(rows)
    by_name = Counter(name for _, _, name in rows)
    want = {a: sum(c for b, c in by_name.items() if b is None or b < a) * 32 // n for a in names[:8]}
    assert len(set(want.values())) == 8
    docs = documents(spark, rows).repartition(3)
    assert {r.source: r._level for r in sharding.string_levels(docs, "source", n, 5).collect()} == want
    got = sharding.hilbert_shards(docs, shards=9, dimensions=("source",)).collect()
    curve = {i: s for i, _, s in rows}
    assert all(r.curve == want.get(curve[r.doc_id], 0) for r in got)
    check(rows, got, 9)


def test_messy_and_empty(spark):
    check(MESSY, sharding.hilbert_shards(messy(spark)).collect(), 16)
    assert sharding.hilbert_shards(empty(spark)).collect() == []


def test_written_shards_hold_all_columns(spark):
    path = scratch_path(spark, "shards-test")
    docs = messy(spark).drop("size")
    sharding.write_shards(docs, path, shards=3, rows_per_file=2)
    back = spark.read.parquet(path)
    assert back.count() == len(MESSY) and set(docs.columns) <= set(back.columns)
    assert sorted(str(r.text) for r in back.collect()) == sorted(str(t) for _, t, _ in MESSY)
