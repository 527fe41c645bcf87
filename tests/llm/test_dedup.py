"""Exact dedup: against a dictionary of whole texts, with clashing digests, and over several batches."""

import hashlib
import re
from collections import defaultdict

import pytest
from fixtures import MESSY, documents, empty, messy
from pyspark.sql import functions as F

from leadloom.llm import dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((i, len(t or "")))
    out = []
    for text, members in groups.items():
        keep = sorted(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0][0]
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(members), i == keep, digest) for i, _ in members]
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()], key=str)


SPACED = [(20, "a b\x0bc", "s"), (21, "abc", "s"), (22, "a  b  c  ", "s"), (23, "a bc", "s"),
          (-5, "a b c    ", "s"), (24, "é" * 9, "t"), (25, "é" * 9, "t"), (26, "\U0001f600 x", "t")]


def test_messy_rows(spark):
    assert rows_of(dedup.exact_groups(messy(spark))) == brute(MESSY)


def test_spaces_and_ties(spark):
    rows = SPACED + [(100 + i, "same text", "hot") for i in range(200)]
    assert rows_of(dedup.exact_groups(documents(spark, rows).repartition(4))) == brute(rows)


def test_empty(spark):
    assert dedup.exact_groups(empty(spark)).collect() == []


@pytest.mark.parametrize("width", [0, 1])
def test_equal_digests_of_different_texts(spark, width):
    rows = MESSY + SPACED
    weak = lambda text: F.substring(dedup.sha256(text), 1, width)
    assert rows_of(dedup.exact_groups(documents(spark, rows), digest=weak)) == brute(rows)


@pytest.mark.parametrize("waves", [1, 2, 5])
def test_state_is_kept_between_batches(spark, waves):
    rows = [(i, f"text {i % 5}", "s") for i in range(40)]
    docs, trace = documents(spark, rows).coalesce(1), []
    assert rows_of(dedup.exact_groups(docs, waves=waves, trace=trace)) == brute(rows)
    batches = [p for p in trace if p["numInputRows"] > 0]
    assert len(batches) == waves
    held = [p["stateOperators"][0]["numRowsTotal"] for p in batches]
    assert held == sorted(held) and held[-1] == 5  # a wave may lack a text, none is ever forgotten


def test_query_hits_the_stored_state(spark):
    rows, trace = [(i, f"same text {i % 3}", "s") for i in range(30)], []
    assert rows_of(dedup.exact_groups(documents(spark, rows), trace=trace)) == brute(rows)
    later = [p for p in trace if p["numInputRows"] > 0][1:]
    assert later and all(p["stateOperators"][0]["numRowsUpdated"] == 3 for p in later)
