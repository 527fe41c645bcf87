"""Counts from deltas, deletion through several tables, change feeds, and tables stored by day."""

import random
import re
from unittest import mock

import pytest
from pyspark.sql import functions as F

from leadloom.operators import filters as P
from leadloom.operators import maintain as D
from leadloom.operators import mutate as M
from leadloom.operators import reports as A
from leadloom.operators.changes import apply_feed, change_feed
from leadloom.sources.tables import read_by_day, write_by_day

ASOF = "2024-05-01 00:00:00"
JOBS = "id long, applied_status string, h1b_confirmed boolean, applied_at timestamp, updated_at timestamp"
MAILS = "id long, job_id long, contact_id long, status string, sent_at timestamp, outreach_type string, body string"


def tables(spark, rng):
    jobs = spark.createDataFrame([(i, rng.choice(["pending", "applied", "interview", None]), rng.choice([True, False, None]), None, None)
                                  for i in range(60)], JOBS)
    mails = spark.createDataFrame([(i, rng.choice([None, i % 60]), i % 9, rng.choice(["draft", "sent", None]), None, "cold_email", "b")
                                   for i in range(90)], MAILS)
    return jobs, mails, spark.range(7)


def row(df):
    return df.first().asDict()


def test_counts_after_several_deltas_equal_a_recount(spark, tmp_path):
    rng = random.Random(1)
    jobs, mails, people = tables(spark, rng)
    dash = D.MaintainedCounts(spark, str(tmp_path / "d"), D.dashboard_metrics())
    funnel = D.MaintainedCounts(spark, str(tmp_path / "f"), D.funnel_metrics())
    groups = A.status_counts(jobs, "applied_status")
    dash.start({"jobs": jobs, "outreach": mails, "contacts": people})
    funnel.start({"jobs": jobs, "outreach": mails})
    for step in range(1, 5):
        delta = spark.createDataFrame([(rng.randrange(80), rng.choice(["pending", "applied", "offer"]), n) for n in range(12)],
                                      "id long, status string, seq int")
        before = D.touched(jobs, delta)
        after = M.status_transition(before, delta, ASOF, ["seq"])
        groups = D.add_groups(groups, D.signed_groups(before, after, ["applied_status"]), ["applied_status"])
        for counts in (dash, funnel, funnel):  # a step that runs twice counts once
            counts.apply(2 * step, "jobs", before, after)
        jobs = spark.createDataFrame(M.status_transition(jobs, delta, ASOF, ["seq"]).collect(), JOBS)
        ids = spark.createDataFrame([(rng.randrange(90),) for _ in range(9)], "id long")
        before = D.touched(mails, ids)
        for counts in (dash, funnel):
            counts.apply(2 * step + 1, "outreach", before, M.mark_sent(before, ids, ASOF))
        mails = spark.createDataFrame(M.mark_sent(mails, ids, ASOF).collect(), MAILS)
        assert row(dash.current()) == row(A.dashboard_stats(jobs, mails, people))
        assert row(funnel.current()) == row(A.funnel_stats(jobs, mails))
        assert set(groups.collect()) == set(A.status_counts(jobs, "applied_status").collect())
    with pytest.raises(ValueError, match="step 0"):
        dash.apply(0, "jobs", before, before)


def test_new_rows_and_deleted_rows_count_too(spark):
    jobs, *_ = tables(spark, random.Random(2))
    none = jobs.where("false")
    metrics = D.funnel_metrics()["jobs"]
    came = {r["metric"]: r["n"] for r in D.signed_counts(none, jobs, metrics).collect()}
    went = {r["metric"]: r["n"] for r in D.signed_counts(jobs, none, metrics).collect()}
    assert came["total_jobs"] == 60 and went == {m: -n for m, n in came.items()}
    assert D.signed_counts(jobs, jobs, metrics).count() == 0


def brute_cascade(data, root, ids, keys):
    """Row by row until nothing changes, with row numbers as identities."""
    gone = {(root, r["id"]) for r in data[root] if r["id"] in ids}
    while True:
        more = {(k.child, r["id"]) for k in keys if k.action == "cascade" for r in data[k.child]
                if (k.parent, r[k.key]) in gone} - gone
        if not more:
            break
        gone |= more
    out = {}
    for name, rows in data.items():
        kept = [dict(r) for r in rows if (name, r["id"]) not in gone]
        for k in keys:
            if k.child == name and k.action == "set_null":
                for r in kept:
                    r[k.key] = None if (k.parent, r[k.key]) in gone else r[k.key]
        out[name] = sorted(map(str, kept))
    return out


@pytest.mark.parametrize("actions", [("set_null", "cascade", "cascade"), ("cascade", "cascade", "set_null"), ("cascade",) * 3])
def test_cascade_through_several_levels(spark, actions):
    rng = random.Random(3)
    pick = lambda n: rng.choice([None, *range(n + 3)])  # noqa: E731  some keys have no parent from the start
    data = {"jobs": [{"id": i} for i in range(20)], "contacts": [{"id": i, "job_id": pick(20)} for i in range(40)],
            "outreach": [{"id": i, "job_id": pick(20), "contact_id": pick(40)} for i in range(80)],
            "replies": [{"id": i, "outreach_id": pick(80)} for i in range(60)], "log": [{"id": 1, "job_id": 2}]}
    keys = (M.ForeignKey("replies", "outreach_id", "outreach", "cascade"), M.ForeignKey("contacts", "job_id", "jobs", actions[0]),
            M.ForeignKey("outreach", "contact_id", "contacts", actions[1]), M.ForeignKey("outreach", "job_id", "jobs", actions[2]))
    frames = {n: spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} long" for c in rows[0]))
              for n, rows in data.items()}
    ids = spark.createDataFrame([(i,) for i in (1, 4, 4, 9, 19, 77)], "id long")
    got = M.delete_cascade(frames, "jobs", ids, keys)
    want = brute_cascade(data, "jobs", {1, 4, 9, 19}, keys)
    assert {n: sorted(str(r.asDict()) for r in df.collect()) for n, df in got.items()} == want


def test_keys_in_a_cycle_are_refused(spark):
    one = spark.range(3).withColumn("b", F.col("id"))
    keys = (M.ForeignKey("y", "b", "x", "cascade"), M.ForeignKey("x", "b", "y", "cascade"))
    with pytest.raises(ValueError, match="cycle"):
        M.delete_cascade({"x": one, "y": one}, "x", spark.range(1), keys)


def test_feed_leads_from_one_version_to_the_next(spark):
    kind = "id long, a string, b string, c double"
    old = spark.createDataFrame([(1, "x", None, 1.0), (2, None, "x", 2.0), (3, "k", "k", None), (4, "p", "q", 0.5), (5, None, None, None)], kind)
    new = spark.createDataFrame([(1, None, "x", 1.0), (2, None, "x", 2.0), (4, "q", "p", 0.5), (5, None, None, 0.0), (6, None, None, None)], kind)
    feed = change_feed(old, new, "id")
    assert {(r["id"], r["change"]) for r in feed.collect()} == {
        (1, "update"), (3, "delete"), (4, "update"), (5, "update"), (6, "insert")}
    assert set(apply_feed(old, feed, "id").collect()) == set(new.collect())
    assert change_feed(new, new, "id").count() == 0
    assert {r["change"] for r in change_feed(new, new.where("false"), "id").collect()} == {"delete"}
    with pytest.raises(ValueError, match="columns differ"):
        change_feed(old, new.drop("c"), "id")


def test_only_the_days_asked_for_are_opened(spark, tmp_path):
    log = spark.range(2000).select("id", F.expr("timestamp_seconds(id * 3600) as created_at"))
    path = write_by_day(log, str(tmp_path / "log"))
    stored = read_by_day(spark, path, log.schema)

    def filters(df):
        spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
        try:
            plan = df._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.maxMetadataStringLength")
        return re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan, re.DOTALL)[1]

    newest = P.last_day(stored)
    assert "day#" in filters(newest) and "ubquery" in filters(newest)  # the subquery prunes folders
    assert newest.count() == 2000 - 83 * 24
    fresh = P.fresh_stored(stored, 30, "1970-02-10 12:00:00")
    assert "day#" in filters(fresh) and "1970-02-09" in filters(fresh)
    assert sorted(r["id"] for r in fresh.collect())[0] == 40 * 24 + 12 - 30
    assert {r["id"] for r in P.last_day(stored, 83).collect()} == set(range(24))
    assert P.fresh_stored(stored, 0, ASOF).count() == 2000


def test_a_step_joins_up_small_partitions_only(spark, tmp_path):
    """64 MB of shuffled ids unfold to several GB of sorted rows in one task."""
    key, asked = "spark.sql.adaptive.advisoryPartitionSizeInBytes", []
    counts = D.MaintainedCounts(spark, str(tmp_path / "counts"), D.dashboard_metrics())
    before, rows = spark.conf.get(key), spark.range(10).select("id", F.lit("draft").alias("status"))
    with mock.patch("pyspark.sql.readwriter.DataFrameWriter.parquet", lambda *_: asked.append(spark.conf.get(key))):
        counts.apply(1, "outreach", rows, rows)
    assert [int(a) for a in asked] == [4 << 20] and spark.conf.get(key) == before
