"""Streams against their batch forms, reruns and late rows."""

from pyspark.sql import functions as F

from leadloom.operators.merge import merge_jobs
from leadloom.streaming import jobs as S

LOG = "event string, created_at timestamp"


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_digest_closes_days_and_drops_late_rows(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))

    def log(*pairs):
        df = spark.createDataFrame(list(pairs), "event string, t string")
        df.select("event", F.col("t").cast("timestamp").alias("created_at")).coalesce(1) \
            .write.mode("append").parquet(src)

    def run():
        stream = S.file_stream(spark, src, spark.read.parquet(src).schema)
        S.run_digest(S.stream_digest(stream, "1 hour"), out, cp).awaitTermination()
        return sorted((str(r["day"]), r["event"], r["label"], r["n"])
                      for r in spark.read.parquet(out).collect())

    log(("a_b", "2024-01-01 10:00:00"), ("a_b", "2024-01-01 11:00:00"), ("c", "2024-01-02 02:00:00"))
    first = [("2024-01-01", "a_b", "A B", 2)]
    assert run() == first
    log(("a_b", "2024-01-01 23:00:00"), ("c", "2024-01-03 05:00:00"))  # the first row is too late
    assert run() == [*first, ("2024-01-02", "c", "C", 1)]


JOB = ("id long, company string, role string, jd_url string, source string, location string, "
       "description string, h1b_confirmed boolean, applied_status string, applied_at timestamp, "
       "created_at timestamp, updated_at timestamp")
DELTA = ("company string, role string, jd_url string, source string, location string, "
         "description string, h1b_confirmed boolean, seq int")
ASOF = "2024-05-01 00:00:00"


def test_ingest_equals_batch_merge(spark, tmp_path):
    src, log, cp = (str(tmp_path / n) for n in ("src", "log", "cp"))
    old = spark.createDataFrame([(1, "c", "r", "u1", "s", "l", "d", False, "applied", None, None, None)],
                                JOB)
    waves = [[("c1", "r1", "u1", "s", "l", None, True, 1), ("c2", "r2", "u2", "s", "l", "x", False, 2)],
             [("c3", "r3", "u2", "s", "l", "later", False, 1), ("c4", "r4", "u3", "s", "l", "", True, 2)]]
    for n, wave in enumerate(waves):
        put(spark, wave, DELTA, src)
        stream = S.file_stream(spark, src, spark.read.parquet(src).schema, max_files=1)
        S.stream_ingest(stream, log, cp, f"2024-05-0{n + 1}").awaitTermination()
    got = S.ingested_jobs(old, log, ASOF, ["seq"])
    every = [(*row[:-1], 10 * n + row[-1]) for n, wave in enumerate(waves) for row in wave]
    want = merge_jobs(old, spark.createDataFrame(every, DELTA), ASOF, ["seq"])
    key = lambda r: r["jd_url"]
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert {r["jd_url"]: r["description"] for r in got.collect()} == {
        "u1": "d", "u2": "later", "u3": ""}


def test_release_is_idempotent(spark, tmp_path):
    src, ledger = str(tmp_path / "src"), str(tmp_path / "ledger")
    schema = "id long, job_id long, contact_id long, outreach_type string, status string, followup_day int"
    put(spark, [(1, 1, 1, "followup", "draft", 3), (2, 1, 2, "followup", "draft", 3),
                (3, 1, 1, "followup", "draft", 7), (4, 1, 1, "followup", "sent", 3)], schema, src)
    jobs = spark.createDataFrame([(1, "c", "r")], "id long, company string, role string")
    contacts = spark.createDataFrame([(1, "A", "a@x", "hr"), (2, "B", "", "hr")],
                                     "id long, name string, email string, contact_type string")

    def run(checkpoint):
        stream = S.file_stream(spark, src, spark.read.parquet(src).schema)
        S.release_followups(stream, jobs, contacts, 3, ledger, str(tmp_path / checkpoint),
                            ASOF).awaitTermination()
        return sorted((r["id"], r["to_email"]) for r in S.read_ledger(spark, ledger).collect())

    assert run("cp1") == [(1, "a@x")]
    assert run("cp1") == [(1, "a@x")]
    assert run("cp2") == [(1, "a@x")]
    put(spark, [(5, 1, 1, "followup", "draft", 3)], schema, src)
    assert run("cp1") == [(1, "a@x"), (5, "a@x")]
