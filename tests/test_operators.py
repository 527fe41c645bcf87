"""Joins, merges, mutations and rankings on small fixtures."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from leadloom.operators import link as L
from leadloom.operators import merge as G
from leadloom.operators import mutate as M
from leadloom.operators import outreach as O
from leadloom.operators import ranking as R
from leadloom.operators import reports as A
from leadloom.functions.text import norm_company

ASOF = "2024-05-01 00:00:00"
COMPANY = ("id long, name string, h1b_confirmed boolean, h1b_source string, lca_count long, "
           "domain string, created_at timestamp")
JOB = ("id long, company string, role string, jd_url string, source string, location string, "
       "description string, h1b_confirmed boolean, applied_status string, applied_at timestamp, "
       "created_at timestamp, updated_at timestamp, seq int")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- link ---

def linked(spark, left, right, **kw):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(left)], "id int, company string")
    names = spark.createDataFrame([(n,) for n in right], "name string")
    out = L.substring_link(df, names, "company", "name", spread=["id"], **kw)
    return [r["h1b_confirmed"] for r in out.orderBy("id").collect()]


def test_link_directions_and_short_names(spark):
    got = linked(spark, ["Acme Web Services Inc.", "Ac", "Zed", "xy", "", None, "IBM Corp"],
                 ["Acme LLC", "xyz", "ibm"])
    assert got == [True, True, False, True, True, True, True]


def test_link_empty_names(spark):
    assert linked(spark, ["", "Abc"], ["zzz"]) == [True, False]
    assert linked(spark, ["", "Abc"], ["zzz"], min_len=1) == [False, False]
    assert linked(spark, ["", "Abc"], ["Inc.", " , "]) == [True, True]
    assert linked(spark, ["", "Abc"], []) == [False, False]


@pytest.mark.parametrize("k", [1, 3])
def test_link_equals_pairwise(spark, k):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("ab c") for _ in range(rng.randint(0, 6)))
    left, right = [word() for _ in range(120)], [word() for _ in range(8)] + ["abcab", "aa"]
    right = [w for w in right if len(w.strip()) > 1]
    norm = lambda names: [r[0] for r in spark.createDataFrame(
        [(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i")
        .select(norm_company("n")).collect()]
    lefts, rights = norm(left), norm(right)
    want = [any(a in b or b in a for b in rights) for a in lefts]
    assert linked(spark, left, right, k=k) == want


def test_tag_linked_keeps_set_flags(spark):
    jobs = spark.createDataFrame([(1, "Acme Co", False), (2, "Nope", True), (3, "Nope", False)],
                                 "id int, company string, h1b_confirmed boolean")
    names = spark.createDataFrame([("acme",)], "name string")
    assert rows(L.tag_linked(jobs, names), "id", "h1b_confirmed") == [(1, True), (2, True), (3, False)]


# --- merges ---

def test_merge_companies(spark):
    stamp = F.lit("2020-01-01").cast("timestamp")
    old = spark.createDataFrame([(1, "Acme", True, None, 5, "a.com", None),
                                 (2, "Kept", False, "s", None, None, None)], COMPANY).withColumn(
        "created_at", stamp)
    delta = spark.createDataFrame([(None, "Acme", False, "x", 9, "", None),
                                   (None, "New", False, None, 1, "n.com", None),
                                   (None, "New", True, "y", 0, "", None),
                                   (None, "Kept", False, None, 3, None, None)], COMPANY).withColumn(
        "seq", F.monotonically_increasing_id())
    cols = ("name", "id", "h1b_confirmed", "h1b_source", "lca_count", "domain")
    assert rows(G.merge_companies(old, delta, ASOF, ["seq"]), *cols) == [
        ("Acme", 1, True, "x", 9, ""), ("Kept", 2, False, "s", 3, None),
        ("New", 3, True, "y", 1, "")]
    kept = G.merge_companies(old, delta, ASOF, ["seq"], nullif_empty=True, with_ids=False)
    assert rows(kept, "name", "domain") == [("Acme", "a.com"), ("Kept", None), ("New", "n.com")]
    filled = R.fill_ids(kept, "id", ["name"])
    assert rows(filled, "name", "id") == [("Acme", 1), ("Kept", 2), ("New", 3)]


def sequential_jobs(old, delta):
    """The upsert applied row by row."""
    table = {r["jd_url"]: dict(r) for r in old}
    for d in delta:
        if not d["jd_url"]:
            continue
        have = table.get(d["jd_url"])
        if have is None:
            table[d["jd_url"]] = {**d, "id": None, "touched": True}
        else:
            if d["description"] is not None:
                have["description"] = d["description"]
            have["h1b_confirmed"] = have["h1b_confirmed"] or d["h1b_confirmed"]
            have["touched"] = True
    return sorted((u, r["id"], r["company"], r["role"], r["description"], r["h1b_confirmed"],
                   bool(r.get("touched"))) for u, r in table.items())


def test_merge_jobs_equals_row_by_row(spark):
    rng = random.Random(3)

    def row(i, url):
        return (i, f"c{i}", f"r{i}", url, "s", "l", rng.choice([None, "", f"d{i}"]),
                rng.random() < .3, "applied", None, None, None, i)

    old_rows = [row(i, f"u{i}") for i in range(5)]
    delta_rows = [row(100 + i, rng.choice([None, "", *[f"u{n}" for n in range(9)]])) for i in range(40)]
    stamp = F.lit("2020-01-01").cast("timestamp")
    old = spark.createDataFrame(old_rows, JOB).withColumns({"created_at": stamp, "updated_at": stamp})
    delta = spark.createDataFrame(delta_rows, JOB)
    names = old.columns
    as_dicts = lambda rs: [dict(zip(names, r)) for r in rs]
    out = G.merge_jobs(old, delta, ASOF, ["seq"], with_ids=False).withColumn(
        "touched", F.col("updated_at") == F.lit(ASOF).cast("timestamp"))
    got = [tuple(r) for r in out.select("jd_url", "id", "company", "role", "description",
                                        "h1b_confirmed", "touched").collect()]
    key = lambda r: r[0]
    assert sorted(got, key=key) == sorted(
        sequential_jobs(as_dicts(old_rows), as_dicts(delta_rows)), key=key)
    status = dict(out.select("jd_url", "applied_status").collect())
    assert status["u0"] == "applied" and status["u8"] == "pending"


def test_insert_ignore_and_violations(spark):
    old = spark.createDataFrame([(1, "a", "x")], "id int, k string, v string")
    delta = spark.createDataFrame([(2, "a", "y"), (4, "b", "q"), (3, "b", "p")], old.schema)
    out = G.insert_ignore(old, delta, "k", ["id"])
    assert rows(out, "id", "k", "v") == [(1, "a", "x"), (3, "b", "p")]
    assert rows(G.unique_violations(delta, "k"), "k", "n") == [("b", 2)]


# --- mutations ---

def test_reset(spark):
    jobs = spark.createDataFrame(
        [(i, s, True) for i, s in enumerate(("applied", "applying", "failed", "interview"))],
        "id int, applied_status string, selected boolean")
    assert rows(M.reset_jobs(jobs), "id", "applied_status", "selected") == [
        (0, "pending", False), (1, "pending", False), (2, "pending", False), (3, "interview", False)]
    sent = spark.createDataFrame([(1, "sent", "t"), (2, "replied", None)],
                                 "id int, status string, sent_at string")
    assert rows(M.reset_outreach(sent), "id", "status") == [(1, "draft"), (2, "replied")]
    assert M.reset_outreach(sent).where("sent_at is not null").count() == 1
    assert M.reset_preview(jobs, sent).count() == 4


def test_status_transition_stamps_any_status(spark):
    jobs = spark.createDataFrame([(1, "pending"), (2, "pending")], "id int, applied_status string") \
        .withColumns({c: F.lit(None).cast("timestamp") for c in ("applied_at", "updated_at")})
    delta = spark.createDataFrame([(2, "rejected")], "id int, status string")
    out = M.status_transition(jobs, delta, ASOF)
    assert rows(out.withColumn("t", F.col("applied_at").isNotNull()), "id", "applied_status", "t") == [
        (1, "pending", False), (2, "rejected", True)]


def test_foreign_keys(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "cid int, job_id int")
    parent = spark.createDataFrame([(10,)], "id int")
    assert rows(M.fk_orphans(child, parent, "job_id"), "cid") == [(2,)]
    assert rows(M.fk_cascade(child, parent, "job_id"), "cid") == [(1,), (3,)]
    nulled = M.fk_cascade(child, parent, "job_id", action="set_null")
    assert dict(nulled.select("cid", "job_id").collect()) == {1: 10, 2: None, 3: None}
    with pytest.raises(ValueError):
        M.fk_cascade(child, parent, "job_id", action="x")


# --- outreach ---

CONTACT = "job_id int, email string, pos int, src string"


@pytest.mark.parametrize("primary, want", [
    ([(1, "a@x", 0, "p")], [("a@x", "p"), ("b@x", "f0")]),
    ([(1, "a@x", 0, "p"), (1, "a@x", 1, "p")], [("a@x", "p"), ("a@x", "p")]),
    ([], [("a@x", "f0"), ("b@x", "f0")]),
])
def test_fallback_enrich(spark, primary, want):
    fallback = [(1, "a@x", 0, "f0"), (1, "b@x", 1, "f0"), (1, "b@x", 2, "f1")]
    out = O.fallback_enrich(spark.createDataFrame(primary, CONTACT),
                            spark.createDataFrame(fallback, CONTACT))
    assert rows(out, "email", "src") == want


def test_plan_followups_and_force(spark):
    df = spark.createDataFrame([(7, 3)], "job_id int, contact_id int")
    out = O.plan_followups(df)
    assert rows(out, "job_id", "contact_id", "followup_day", "status", "outreach_type") == [
        (7, 3, d, "draft", "followup") for d in (3, 7, 14)]
    assert O.todo(df, df, "job_id").count() == 0
    assert O.todo(df, df, "job_id", force=True).count() == 1
    assert O.ready(df, df.unionAll(df), "job_id", spread=["contact_id"]).count() == 1


# --- ranking ---

def test_numbering_is_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    out = R.number_rows(df.repartition(7), ["k"])
    assert out.where(F.col("row_no") != F.col("k") + 1).count() == 0
    old = spark.createDataFrame([(41, 0)], "id long, k long")
    grown = R.append_with_ids(old, df, "id", ["k"])
    assert grown.agg(F.min("id"), F.max("id"), F.countDistinct("id")).first() == (41, 1041, 1001)


def test_running_offset_of_one_large_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("key"),
                                  F.col("id").alias("pos"), (F.col("id") % 3).alias("n"))
    got = R.running_offset(df, "key", "pos", "n").where("key = 1").orderBy("pos").collect()
    total = 0
    for r in got:
        assert r["offset"] == total
        total += r["n"]
    assert len(got) == 4000


@pytest.mark.parametrize("new, want", [
    (["n1", "n2", "n3"], [(0, ["n1", "n2"]), (1, ["n3"])]),
    (["n1"], [(0, ["n1"]), (1, ["c", "d"])]),
    ([], [(0, ["a", "b"]), (1, ["c", "d"])]),
])
def test_distribute_bullets(spark, new, want):
    entries = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c", "d"])],
                                    "key int, pos int, bullets array<string>")
    bullets = spark.createDataFrame([(1, new)], "key int, new_bullets array<string>")
    out = R.distribute_bullets(entries, bullets, "key")
    assert sorted(tuple(r) for r in out.select("pos", "bullets").collect()) == want


def test_exploded_bullets_are_never_broadcast(spark):
    """Their size is unknown before they are exploded: a small table may hold very many."""
    entries = spark.createDataFrame([(1, 0, ["a", "b"])], "key int, pos int, bullets array<string>")
    bullets = spark.createDataFrame([(1, ["n"])], "key int, new_bullets array<string>")
    plan = R.distribute_bullets(entries, bullets, "key")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[key#\d+, _slot#", plan)
    assert re.search(r"SortMergeJoin \[key#\d+, _part#", plan)


def test_latest_first_cap(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")],
                               "k string, n int, v string")
    assert rows(R.latest_per_key(df, ["k"], ["n"]), "k", "v") == [("a", "z"), ("b", "q")]
    assert rows(R.first_per_key(df, ["k"], ["n"]), "k", "v") == [("a", "x"), ("b", "q")]
    assert rows(R.cap_per_group(df, ["k"], ["n"], 2), "k", "n") == [("a", 1), ("a", 2), ("b", 1)]


# --- reports ---

def test_reports_on_empty_tables(spark):
    jobs = spark.createDataFrame([], "h1b_confirmed boolean, applied_status string")
    outreach = spark.createDataFrame([], "status string")
    assert tuple(A.funnel_stats(jobs, outreach).first()) == (0, 0, 0, 0, 0)
    assert tuple(A.match_rate(jobs).first()) == (0, 0, 0.0)
    log = spark.createDataFrame([], "event string, created_at timestamp")
    text = A.digest_text(A.funnel_stats(jobs, outreach), A.daily_digest(log, "2024-01-15"),
                         "2024-01-15").first()["text"]
    assert text.endswith("Events of the day: 0\n- nothing recorded")


def test_updates_of_one_id_apply_in_turn(spark):
    from leadloom import schemas
    from leadloom.operators import mutate as M
    from leadloom.sources import sinks as K
    jobs = spark.createDataFrame([(i, "pending", 0, None) for i in (1, 2, 3)],
                                 "id long, applied_status string, ats_score int, ats_grade string")
    jobs = jobs.withColumns({"applied_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")})
    delta = spark.createDataFrame([(1, "applied", 1), (1, "failed", 2), (2, None, 3), (9, "x", 1), (None, "x", 1)],
                                  "id long, status string, seq int")
    out = M.status_transition(jobs, delta, "2024-01-01 00:00:00", ["seq"])
    assert rows(out, "id", "applied_status") == [(1, "failed"), (2, "pending"), (3, "pending")]
    scores = spark.createDataFrame([(1, 50, "D", 1), (1, 90, "A", 2)], "id long, score int, grade string, seq int")
    assert rows(M.score_writeback(jobs, scores, ["seq"]), "id", "ats_score") == [(1, 90), (2, 0), (3, 0)]
    meta = spark.createDataFrame([(1, "a"), (2, "b")], "job_id long, company string")
    patch = spark.createDataFrame([(1, "z", 1, "n", 1), (1, None, 2, "m", 2), (5, "q", 1, "n", 1)],
                                  "job_id long, company string, round int, note string, seq int")
    kept = K.metadata_patch(meta, patch, "2024-01-01 00:00:00", seq=["seq"])
    assert rows(kept, "job_id", "company", "round", "note") == [(1, "a", 2, "m"), (2, "b", None, None)]
    nulled = K.metadata_patch(meta, patch, "2024-01-01 00:00:00", seq=["seq"], nulls=True)
    assert rows(nulled, "job_id", "company") == [(1, None), (2, "b")]
    assert schemas.JOBS.names


def test_upserts_keep_columns_give_ids_and_refuse_null_names(spark):
    from leadloom import schemas
    old = spark.createDataFrame([(7, "Acme", True, None, 5, "a", None)], schemas.COMPANIES).withColumn("x", F.lit("k"))
    delta = spark.createDataFrame([(None, None, True, "s", 1, "d", None), (None, "B", False, "s", 1, "d", None),
                                   (None, "A", False, "s", 1, "d", None)], schemas.COMPANIES)
    delta = delta.withColumn("seq", F.lit(1))
    once = G.merge_companies(old, delta, "2024-01-01 00:00:00", ["seq"])
    again = G.merge_companies(once, delta, "2024-01-02 00:00:00", ["seq"])
    assert rows(again, "id", "name", "x") == [(7, "Acme", "k"), (8, "A", None), (9, "B", None)]


def test_scratch_is_dropped(spark):
    import os

    from leadloom import session
    path = session.scratch_path(spark, "dropped")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file://")
    assert os.path.isdir(local)
    held, session._scratch = session._scratch, {path}
    try:
        assert session.drop_scratch(spark) == 1 and not os.path.isdir(local)
    finally:
        session._scratch = held


def test_link_cuts_only_anchors_that_occur(spark):
    import random

    from leadloom.operators.link import anchored, linked_names

    rng = random.Random(7)
    word = lambda low, high: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(low, high)))
    left = {word(0, 9) for _ in range(150)} | {"zz", "z" * 30, "ab"}
    right = {word(3, 12) for _ in range(80)} | {"b"}
    rows = [(n, True) for n in left] + [(n, False) for n in right]
    names = spark.createDataFrame(rows, "name string, is_left boolean")
    want = {n for n in left if any(n in m or m in n for m in right)}
    assert {r["name"] for r in linked_names(names).collect()} == want
    assert {r["name"] for r in linked_names(names, k=2, salts=1).collect()} == want
    cut = anchored(names).where("anchor <> ''").collect()
    every = sum(min(4, len(n) - i) for n, _ in rows for i in range(len(n)))
    assert len(cut) < every
    firsts = {side: {(m[:1], min(4, len(m))) for m in (left if side else right)} for side in (True, False)}
    assert all((r["anchor"][:1], len(r["anchor"])) in firsts[r["other"]] for r in cut)
    assert not [r for r in cut if r["anchor"].startswith("z") and not r["other"]]  # no right name begins with it


def test_names_of_a_small_file_are_looked_up_by_shuffle(spark, tmp_path):
    from leadloom.operators.link import linked_names
    spark.range(20_000).selectExpr("concat('customer ', id) AS name", "id % 2 = 0 AS is_left").write.parquet(f"{tmp_path}/names")
    linked = linked_names(spark.read.parquet(f"{tmp_path}/names"))
    want = {f"customer {n}" for n in range(2, 20_000, 2)  # no longer number begins with 0
            if any(int(str(n)[:k]) % 2 for k in range(1, len(str(n)))) or n * 10 + 1 < 20_000}
    assert {r["name"] for r in linked.collect()} == want
    plan = linked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in plan.splitlines() if "Join" in line and "LeftSemi" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
