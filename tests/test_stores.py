"""Tables stored by key, the listing store over several batches, and the partitioned ledger."""

import re

import pytest
from pyspark.sql import functions as F
from test_streaming import ASOF, DELTA, JOB, put

from leadloom.operators import merge as G
from leadloom.operators.link import substring_link
from leadloom.session import scratch_path, scratch_scope
from leadloom.sources.keyed import KeyedTable
from leadloom.sources.tables import path_exists
from leadloom.streaming import jobs as S
from leadloom.streaming.ledger import ReleaseLedger
from leadloom.streaming.listings import ListingStore, arrivals


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def below_scan(plan: str, table: str) -> list[str]:
    """For every scan of ``table`` the operators between it and its join."""
    out, lines = [], plan.splitlines()
    for i, line in enumerate(lines):
        if "FileScan" in line and table in line:
            depth, found = len(re.match(r"[\s:|+*-]*", line)[0]), []
            for above in reversed(lines[:i]):
                d = len(re.match(r"[\s:|+*-]*", above)[0])
                if d < depth:
                    depth = d
                    found.append(above.strip(" :+-*"))
                    if "Join" in above:
                        break
            out.append(" / ".join(found))
    return out


COMPANY = "id long, name string, h1b_confirmed boolean, h1b_source string, lca_count long, domain string, created_at timestamp, extra int"


def companies(spark, ids):
    return spark.createDataFrame([(i, f"n{i}", i % 2 == 0, None, i, "", None, i) for i in ids], COMPANY)


def test_merge_of_a_stored_table_moves_only_the_delta(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = KeyedTable(spark, str(tmp_path / "t"), "name", buckets=5)
        table.create(companies(spark, range(1, 200)))
        delta = companies(spark, range(150, 260)).withColumns({"seq": F.col("id"), "lca_count": F.col("id") * 2})
        merged = G.merge_companies_stored(table.read(), delta, ASOF, ["seq"], table.buckets)
        scans = below_scan(plan_of(merged), table._name(0))
        joined = [s for s in scans if "Join" in s and "Aggregate" not in s]  # the greatest id is a partial maximum
        assert any("FullOuter" in s for s in joined)
        assert not any("Exchange" in s for s in joined)
        want = G.merge_companies(companies(spark, range(1, 200)), delta, ASOF, ["seq"])
        key = lambda r: r["name"]
        assert sorted(merged.collect(), key=key) == sorted(want.select(*merged.columns).collect(), key=key)
        table.write(merged, 1)
        files = {f.split("/")[-1] for f in table.read().inputFiles()}
        assert len(files) == 5  # one task and one file for each bucket
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_versions(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "name", buckets=2)
    with pytest.raises(ValueError, match="no complete version"):
        table.latest()
    for n in range(4):
        table.write(companies(spark, range(n)), n)
    (tmp_path / "t" / "version=000000003" / "_SUCCESS").unlink()  # as if the job had died
    assert table.versions() == [0, 1, 2] and table.read().count() == 2
    table.write(companies(spark, range(7)), 3)
    assert table.read().count() == 7
    assert table.forget(2) == 2 and table.versions() == [2, 3]
    spark.sql(f"DROP TABLE {table._name(3)}")  # another session does not know the table
    again = table.read()
    assert again.count() == 7 and "Bucketed: true" in plan_of(again.groupBy("name").count())


def listing(n, url, company, text=None, seq=0):
    return (company, f"r{n}", url, "s", "l", text, None, seq)


WAVES = [[listing(1, "u1", "Acme Inc.", None, 1), listing(2, "u2", "Blue Sky", "x", 2), listing(3, None, "Acme", "no url", 3)],
         [listing(4, "u2", "Acme Labs", "later", 1), listing(5, "u3", "Cold", "", 2), listing(6, "u3", "Other", None, 3)],
         [listing(7, "u1", "Blue Sky", "new", 1), listing(8, "u4", "Acme", None, 2), listing(9, "u2", "Zed", "", 3)]]


@pytest.mark.parametrize("keep_text, refresh_at", [(False, (0, 2)), (True, (2,)), (False, (0, 1, 2))])
def test_batches_equal_one_merge(spark, tmp_path, keep_text, refresh_at):
    old = spark.createDataFrame([(1, "c", "r", "u1", "s", "l", "d", False, "applied", None, None, None)], JOB)
    sponsors = spark.createDataFrame([("ACME LLC",), ("Nothing",)], "name string")
    store, src = ListingStore(spark, str(tmp_path / "store"), 3, keep_text), str(tmp_path / "src")
    store.create(old)
    read = []
    for n, wave in enumerate(WAVES):
        put(spark, wave, DELTA, src)
        store.ingest(S.file_stream(spark, src, spark.read.parquet(src).schema), sponsors, ["seq"]).awaitTermination()
        if n in refresh_at:
            before, waiting = store.current(ASOF), store.pending()
            read.append(sorted({int(re.search(r"batch=(\d+)", f)[1]) for f in waiting.inputFiles()}))
            rows = sorted(map(str, before.collect()))
            assert store.refresh(ASOF) == n + 1 and sorted(map(str, store.table.read().collect())) == rows
    assert store.pending() is None and store.refresh(ASOF) == 3
    # a refresh reads the batches since the last one and no others
    assert read == {(0, 2): [[0], [1, 2]], (2,): [[0, 1, 2]], (0, 1, 2): [[0], [1], [2]]}[refresh_at]

    every = [(*row[:-1], 10 * n + row[-1]) for n, wave in enumerate(WAVES) for row in wave]
    linked = substring_link(spark.createDataFrame(every, DELTA), sponsors, "company", "name")
    want = G.merge_jobs(old, linked, ASOF, ["seq"], keep_text).drop("id")
    assert sorted(map(str, store.table.read().drop("id").collect())) == sorted(map(str, want.collect()))
    ids = sorted(r["id"] for r in store.table.read().collect())
    assert ids == [1, 2, 3, 4]


def test_replayed_batch_and_trim(spark, tmp_path):
    old = spark.createDataFrame([], JOB)
    sponsors = spark.createDataFrame([("Acme",)], "name string")
    store, src = ListingStore(spark, str(tmp_path / "store"), 2), str(tmp_path / "src")
    store.create(old)
    for wave in WAVES:
        put(spark, wave, DELTA, src)
        stream = arrivals(S.file_stream(spark, src, spark.read.parquet(src).schema))
        store.ingest(stream, sponsors, ["arrived", "seq"]).awaitTermination()
        if wave is WAVES[1]:  # the last commit is lost: the batch runs again into its own folder
            for f in (tmp_path / "store" / "checkpoint" / "commits").glob("*1*"):
                f.unlink()
            store.ingest(stream, sponsors, ["arrived", "seq"]).awaitTermination()
        store.refresh(ASOF)
    assert {r["jd_url"]: (r["role"], r["description"], r["h1b_confirmed"]) for r in store.table.read().collect()} == {
        "u1": ("r1", "new", True), "u2": ("r2", "", True), "u3": ("r5", "", False), "u4": ("r8", None, True)}
    assert store.trim(keep=1) == 3 + 3
    assert store.table.versions() == [3] and not (tmp_path / "store" / "log" / "batch=000000002").exists()


DRAFT = "id long, job_id long, contact_id long, outreach_type string, status string, followup_day int"


def test_ledger_over_batches_reruns_and_compaction(spark, tmp_path):
    src = str(tmp_path / "src")
    jobs = spark.createDataFrame([(1, "c", "r")], "id long, company string, role string")
    people = spark.createDataFrame([(1, "A", "a@x", "hr"), (2, "B", "", "hr")],
                                   "id long, name string, email string, contact_type string")
    ledger = ReleaseLedger(spark, str(tmp_path / "ledger"), buckets=4)
    seen = []

    def run(day, checkpoint, max_files=None):
        stream = S.file_stream(spark, src, spark.read.parquet(src).schema, max_files)
        ledger.release(stream, jobs, people, day, str(tmp_path / checkpoint), ASOF).awaitTermination()
        assert ledger.rows().count() == ledger.released().count()  # nothing was released twice
        seen.append(sorted((r["id"], r["followup_day"], r["to_email"]) for r in ledger.released().collect()))
        return seen[-1]

    for base in (0, 100, 200):
        put(spark, [(base + i, 1, 1 + i % 2, "followup", "draft" if i % 5 else "sent", 3 if i % 3 else 7)
                    for i in range(40)], DRAFT, src)
    want = lambda day: sorted((b + i, day, "a@x") for b in (0, 100, 200) for i in range(40)
                              if i % 2 == 0 and i % 5 and (3 if i % 3 else 7) == day)
    assert run(3, "a", max_files=1) == want(3)
    assert run(3, "a") == want(3) and run(3, "b") == want(3)
    assert run(7, "c") == sorted(want(3) + want(7))
    folders = sum(map(len, ledger.batches().values()))
    assert ledger.compact() > 0 and sum(map(len, ledger.batches().values())) < folders
    assert ledger.compact() == 0
    assert run(7, "d") == seen[-2]
    put(spark, [(900, 1, 1, "followup", "draft", 7)], DRAFT, src)
    assert run(7, "d") == sorted([*seen[-2], (900, 7, "a@x")])


def test_ledger_reads_only_the_partitions_of_its_drafts(spark, tmp_path):
    ledger = ReleaseLedger(spark, str(tmp_path / "ledger"), buckets=8)
    rows = spark.range(1000).select("id", F.lit(1).cast("bigint").alias("job_id"), F.lit("a").alias("to_email"),
                                    F.lit("t").alias("sent_at"), F.expr("if(id % 2 = 0, 3, 7)").alias("followup_day"),
                                    ledger.bucket().alias("bucket"), F.lit("x-0").alias("batch"))
    ledger._write(rows)
    ledger._write(rows.where("id < 20").withColumn("batch", F.lit("y-1")))
    known = ledger.known(3, [1, 5], but="y-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = plan_of(ledger.known(3, [1, 5], but="y-1"))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pruned = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
    assert all(x in pruned[1] for x in ("= 3)", "IN (1,5)", "batch#")) and pruned[2] == ""
    assert "ReadSchema: struct<id:bigint>" in plan
    got = {(r["id"], r["bucket"]) for r in known.collect()}
    assert got == {(r["id"], r["bucket"]) for r in rows.where("followup_day = 3 and bucket in (1, 5)").collect()} != set()


def test_scratch_scope(spark):
    outside = scratch_path(spark, "out")
    with scratch_scope(spark):
        inside = scratch_path(spark, "in")
        spark.range(2).write.parquet(inside)
        spark.range(2).write.parquet(outside)
    assert path_exists(spark, outside) and not path_exists(spark, inside)
