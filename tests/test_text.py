"""Scalar functions on hand-checked inputs."""

import pytest
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import classify as C
from leadloom.functions import render as N
from leadloom.functions import text as X
from leadloom.functions.sqlfuncs import register_sql_functions


def each(spark, fn, values, dtype="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in rows.orderBy("i").select(fn("x").alias("y")).collect()]


def test_norm_company(spark):
    names = ["Acme Corporation", "Foo Co.", "Acme Ltd., Inc.", "General Incentives Co", " A, B. "]
    assert each(spark, X.norm_company, names) == [
        "acmeoration", "foo", "acme", "generalentives co", "a b"]
    assert each(spark, lambda c: X.norm_company(c, vocab.SPONSOR_REMOVALS), ["Foo Co."]) == ["foo co"]
    whole = each(spark, lambda c: X.norm_company(c, suffix_mode="word_boundary"),
                 ["Acme Corporation", "General Incentives Co", "Foo, Inc."])
    assert whole == ["acme", "general incentives", "foo"]
    with pytest.raises(ValueError):
        X.norm_company("x", suffix_mode="other")


def test_urls(spark):
    assert each(spark, X.url_host, [
        "https://www.Example.com:8080/a?b", "example.com/x", "http://user@www.a.www.b.org",
        "foo.com/?u=http://y.com", "http://[::1]:80/", ""]) == [
        "example.com", "example.com", "a.b.org", "", "::1", ""]
    assert each(spark, X.url_canonical, ["https://a/b?c=1?d", "x"]) == ["https://a/b", "x"]
    assert each(spark, lambda c: X.url_join("https://h.example/a/b", c), [
        "/c", "c", "https://z/q", "//k/x", "?q=1", "#t", "", None]) == [
        "https://h.example/c", "https://h.example/a/c", "https://z/q", "https://k/x",
        "https://h.example/a/b?q=1", "https://h.example/a/b#t", "https://h.example/a/b",
        "https://h.example/a/b"]
    assert each(spark, lambda c: X.view_url("v=", c), ["1", "", None]) == ["v=1", "", ""]


def test_numbers_and_labels(spark):
    assert each(spark, X.digits_to_int, ["1,234 LCAs", "none", None]) == [1234, 0, 0]
    assert each(spark, X.quantity_mentions, ["45% 3x $5 50k 20+ 500000", "3xé", "2 Million"]) == [
        6, 0, 1]
    assert each(spark, X.title_label, ["cold_email_sent", "3day_x", "ÉTÉ_b"]) == [
        "Cold Email Sent", "3Day X", "Été B"]
    assert each(spark, X.template_no, [1, 2, 3, None], "bigint") == [2, 3, 1, 2]
    assert each(spark, lambda c: X.first_date(c, F.lit("2020-02-03T04")), ["", "2021-01-02 09"]) == [
        "2020-02-03", "2021-01-02"]
    assert each(spark, X.strip_markup, ["*a* 📊b📅"]) == ["a b"]


def test_names(spark):
    assert each(spark, X.safe_name, [" A & B (über) ", "x" * 40]) == ["A___B__über_", "x" * 25]
    assert each(spark, lambda c: X.safe_name(c, 30, strip=False), [" a"]) == ["_a"]
    assert each(spark, X.first_name, ["Ann Lee", "Hiring Team", "", None, " Bo"]) == [
        "Ann", "there", "there", "there", "Bo"]
    assert each(spark, X.strip_ws, [" \t a 　\n"]) == ["a"]


@pytest.mark.parametrize("raw, subject, body", [
    ("subject: Hi\n\nBody", "Hi", "Body"),
    ("[subject:] Hi\n[body:]\nB", "Hi", "B"),
    ("Just text ", "", "Just text"),
    ("a [subject b\nc", "", "a [subject b\nc"),
    ("x\nSubject: ] Q\ny", "", "x\nSubject: ] Q\ny"),
    ("[subject]: ] Q\ny\n", "Q", "y"),
    ("subject: A\nsubject: B\nz", "A", "subject: B\nz"),
    ("B\n---\n*Note: x\nmore", "", "B"),
    ("subject: S\nB\n---\n*Note", "S", "B"),
])
def test_parse_labelled(spark, raw, subject, body):
    (row,) = each(spark, X.parse_labelled, [raw])
    assert (row["subject"], row["body"]) == (subject, body)


def test_contaminated(spark):
    assert each(spark, X.is_contaminated, [None, "", "I DON'T HAVE it", "fine"]) == [
        True, True, True, False]
    assert each(spark, X.repaired_subject, ["] ] Hello ", "]x", "ok "]) == ["Hello", "]x", "ok "]


def test_bullets(spark):
    text = "head\n- first bullet here\r\n•second bullet x\n - short\n– third bullet yy\n\t- tabbed bullet"
    assert each(spark, X.extract_bullets, [text, "none"]) == [
        ["first bullet here", "second bullet x", "third bullet yy", "- tabbed bullet"], []]


def test_links(spark):
    html = "see https://jobs.lever.co/a/1 and <a href='https://boards.greenhouse.io/b'>"
    assert each(spark, lambda c: X.link_scan(c, F.lit("own")), [html, "lever.co alone", ""]) == [
        "https://boards.greenhouse.io/b", "own", "own"]
    direct, plain = each(spark, X.route_url, ["easy_apply::https://x/y", "https://x/z//"])
    assert tuple(direct) == (True, "https://x/y", "https://x/y/apply")
    assert tuple(plain) == (False, "https://x/z//", "https://x/z/apply")


def test_classifiers(spark):
    assert each(spark, C.classify_title, [
        "Director of Data", "Chris, Designer", "VP Engineering", "Gardener", "Tech Lead", None]) == [
        "hiring_manager", "hr", "hiring_manager", "other", "team_lead", "other"]
    assert each(spark, C.classify_role, [
        "Data Engineer", "Senior Data Engineer", "Data Analyst", "Analytics Engineer",
        "SQL Developer", "Software Engineer", "Senior Data Analyst", "Data Platform Engineer",
        "Gardener"]) == ["data", "data", "analyst", "analyst", "sql", "sde", "analyst", "data", "data"]
    assert each(spark, C.classify_url, [
        "https://boards.greenhouse.io/x", "https://a.myworkdayjobs.com/y", "https://x.org"]) == [
        "greenhouse", "workday", "unknown"]
    assert each(spark, C.classify_message, ["Rate Limit", "HTTP 401", "429 quota 403", "boom"]) == [
        "credit", "auth", "credit", "other"]


def test_vocabulary_sizes():
    assert len(vocab.HARD_SKILLS) == len(set(vocab.HARD_SKILLS)) == 127
    assert (len(vocab.SOFT_SKILLS), len(vocab.STRONG_VERBS)) == (14, 22)
    assert sum(len(w) for _, w in vocab.EXPERIENCE_LEVELS) == 26
    assert sum(len(w) for _, w in vocab.EDUCATION_LEVELS) == 21
    assert len(vocab.DRAFT_MARKERS) == 23 and len(vocab.ROLE_VARIANTS) == 25


def test_templates(spark):
    got = each(spark, lambda c: N.render_template("<{a}|{b}>", {"a": F.col(c), "b": F.lit("xyz")},
                                                  {"b": 2}), ["q", None])
    assert got == ["<q|xy>", "<|xy>"]
    for day, start in ((3, "Hello,\n\nA few days"), (7, "Hello,\n\nA week"), (14, "Hello,\n\nThis is")):
        (row,) = each(spark, lambda c, d=day: N.render_followup(c, F.lit("R"), F.lit(d), "S"), ["Co"])
        assert row["subject"] == "Following up — R application at Co"
        assert row["body"].startswith(start) and row["body"].endswith("S\n")


def test_sql_functions_equal_columns(spark):
    assert "classify_role" in register_sql_functions(spark)
    spark.createDataFrame([("Senior Recruiter",), ("CTO",), (None,)], "x string") \
        .createOrReplaceTempView("t_titles")
    got = [r[0] for r in spark.sql("SELECT classify_title(x) FROM t_titles").collect()]
    assert got == ["hr", "hiring_manager", "other"]
    row = spark.sql("SELECT quantity_mentions('45% 3x $5 50k 20+ 500000') q, score_grade(84) g, "
                    "digits_to_int('1,234 LCAs') d, classify_url('http://jobs.lever.co/a') u, "
                    "norm_text('A-b_C') n, url_canonical('a?b') c").first()
    assert tuple(row) == (6, "B", 1234, "lever", "a b c", "a")


def test_sql_functions_equal_their_column_forms(spark):
    from leadloom import vocab
    from leadloom.functions import classify as C
    from leadloom.functions import scoring as S
    from leadloom.functions import sqlfuncs
    from leadloom.functions import text as X
    texts = [None, "", " ", "Acme Inc.\t", "\u00a0Foo, LLC \n", "Ltd", "Senior Data Analyst\u2003", "a?b?c", "12,5 x",
             "45% 3x $5 50k", "https://boards.greenhouse.io/x", "Rate LIMIT exceeded", "it's \\ \"q\"", "Chris, Designer"]
    forms = {"norm_company": X.norm_company, "norm_sponsor": lambda c: X.norm_company(c, vocab.SPONSOR_REMOVALS),
             "domain_guess": X.domain_guess, "url_canonical": X.url_canonical, "digits_to_int": X.digits_to_int,
             "norm_text": X.norm_text, "quantity_mentions": X.quantity_mentions, "classify_title": C.classify_title,
             "classify_role": C.classify_role, "classify_url": C.classify_url,
             "classify_message": C.classify_message, "strip_space": X.strip_ws}
    numbers = {"score_grade": S.grade, "score_advice": S.advice}
    assert {*forms, *numbers, "yes_no"} == set(sqlfuncs.register_sql_functions(spark))
    df = spark.createDataFrame([(i, t, i * 9) for i, t in enumerate(texts)], "i int, x string, n int")
    for source, group in (("x", forms), ("n", numbers)):
        for name, form in group.items():
            got = df.select("i", F.expr(f"{name}({source})").alias("a"), form(source).alias("b")).collect()
            assert [r["a"] for r in got] == [r["b"] for r in got], name
    flags = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert all(r[0] == r[1] for r in flags.select(F.expr("yes_no(b)"), X.yes_no("b")).collect())
