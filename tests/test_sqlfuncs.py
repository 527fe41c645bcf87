"""Every SQL function against its Column form, and the table functions."""

import pytest
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import render as Rn
from leadloom.functions import text as X
from leadloom.functions.scoring import keyword_match
from leadloom.functions.sqlfuncs import register_sql_functions, register_table_functions

TEXTS = [None, "", " ", "https://www.Acme.com:8080/a/b?x#y", "user:pw@host.org/p", "http://[2001:DB8::1]:80/x", "//cdn.x/y", "/abs",
         "rel/path", "?q=1", "#frag", "mailto:a@b", "Subject: Hello\n\nBody text\n---\n*Note: gone", "intro\n[Subject:] ] Hi  \n [Body:] \nText\nmore",
         "[subject", "subject:", "SUBJECT: only", "no label\nbody: x", "x\n---\n*a\n---\nb", "- short\n• a long enough bullet\r\n – another long bullet •\n-no space but long",
         "snake_case_label", "x1y_z", "Ünïcode_name é", "Dr. Who?!", "  Anna  Maria ", vocab.PLACEHOLDER_CONTACT, "Python-SQL and spark_streaming, scikit-learn", "2024-05-01 10:11:12"]


@pytest.fixture(scope="module")
def rows(spark):
    register_sql_functions(spark)
    df = spark.createDataFrame([(i, t, TEXTS[-1 - i]) for i, t in enumerate(TEXTS)], "n int, x string, y string")
    df.createOrReplaceTempView("sqlfunc_rows")
    return df


BASE = "https://site.example.com/jobs/list.html?a=1#z"
def forms():
    return {
    "url_host(x)": X.url_host("x"), f"url_join('{BASE}', x)": X.url_join(BASE, "x"),
    "url_join('https://site.example.com', x)": X.url_join("https://site.example.com", "x"),
    "safe_name(x)": X.safe_name("x"), "safe_name(x, 4)": X.safe_name("x", 4), "default_text(x, y, 'c')": X.default_text("x", "y", F.lit("c")),
    "first_name(x)": X.first_name("x"), "title_label(x)": X.title_label("x"), "first_date(x, y)": X.first_date("x", "y"),
    "date_label(timestamp_seconds(n * 100000))": X.date_label(F.expr("timestamp_seconds(n * 100000)")),
    "extract_bullets(x)": X.extract_bullets("x"), "strip_note(x)": X.strip_note("x"), "parse_labelled(x)": X.parse_labelled("x"),
    "keyword_match(x)": keyword_match(X.norm_text("x"), vocab.HARD_SKILLS),
    "draft_file_name(x, n % 4, y, cast(n as bigint))": Rn.draft_file_name("x", F.expr("n % 4"), "y", "n"),
    "draft_file_name('followup', n % 3, y, 1)": Rn.draft_file_name(F.lit("followup"), F.expr("n % 3"), "y", F.lit(1)),
    "draft_file_name('cold_email', 1, y, 1)": Rn.draft_file_name(F.lit("cold_email"), F.lit(1), "y", F.lit(1))}


def test_sql_form_equals_column_form(spark, rows):
    pairs = forms()
    got = spark.sql("SELECT n, " + ", ".join(f"{c} AS v{k}" for k, c in enumerate(pairs)) + " FROM sqlfunc_rows").collect()
    want = rows.select("n", *[e.alias(f"v{k}") for k, e in enumerate(pairs.values())]).collect()
    by_n = {r["n"]: r for r in want}
    assert len(got) == len(TEXTS)
    assert [(list(pairs)[k], TEXTS[r["n"]], r[f"v{k}"], by_n[r["n"]][f"v{k}"]) for r in got for k in range(len(pairs))
            if r[f"v{k}"] != by_n[r["n"]][f"v{k}"]] == []


def test_no_part_is_listed(spark):
    names = register_sql_functions(spark)
    assert {"url_host", "parse_labelled", "norm_company"} <= set(names) and not any(n.startswith("_") for n in names)


def test_table_functions(spark):
    spark.createDataFrame([(1, "c1", "r1", "u1", "d", True, "pending", None), (2, "c2", "r2", "u2", None, True, "pending", None),
                           (3, "c3", "r3", "u3", None, False, "applied", None)],
                          "id long, company string, role string, jd_url string, description string, h1b_confirmed boolean, "
                          "applied_status string, applied_at timestamp").withColumn(
        "applied_at", F.when(F.col("id") == 3, F.expr("timestamp '2024-01-01 00:00:00'"))).createOrReplaceTempView("tf_jobs")
    spark.createDataFrame([(10, 3, 5, "followup", "draft", 7), (11, 3, 5, "followup", "sent", 7), (12, 1, 5, "followup", "draft", 3)],
                          "id long, job_id long, contact_id long, outreach_type string, status string, followup_day int"
                          ).createOrReplaceTempView("tf_outreach")
    spark.createDataFrame([(1, 1)], "id long, job_id long").createOrReplaceTempView("tf_contacts")
    spark.createDataFrame([(i, "r", "c", i % 5, "A") for i in range(20)],
                          "id long, role string, company string, score int, grade string").createOrReplaceTempView("tf_scored")
    names = register_table_functions(spark, "tf_jobs", "tf_outreach", "tf_contacts", "tf_scored")
    ids = lambda q: [r[0] for r in spark.sql(q).collect()]
    assert sorted(ids("SELECT id FROM pending_jobs()")) == [1, 2] and len(names) == 5
    assert ids("SELECT id FROM due_followups(7)") == [10] and ids("SELECT id FROM due_followups(14)") == []
    assert ids("SELECT id FROM due_followups_by_date(TIMESTAMP '2024-01-08 00:00:00')") == [10]
    assert ids("SELECT id FROM due_followups_by_date(TIMESTAMP '2024-01-07 23:00:00')") == []
    assert ids("SELECT jd_url FROM gap_report()") == ["u2"]
    assert ids("SELECT id FROM top_scored(5, 3) ORDER BY rank") == [4, 9, 14, 19, 3]
    assert "TakeOrderedAndProject" in spark.sql("SELECT * FROM top_scored(5, 3)")._jdf.queryExecution().executedPlan().toString()
    # a function is part of the query around it: the filter reaches its inputs
    joined = spark.sql("SELECT p.id, f.id FROM pending_jobs() p JOIN due_followups(3) f ON f.job_id = p.id")
    assert [tuple(r) for r in joined.collect()] == [(1, 12)]
