"""The document score: fixtures and hand-computed totals."""

from pyspark.sql import functions as F

from leadloom.functions.scoring import DEFAULT_VOCAB, ScoreVocab, advice, grade, keyword_gap, \
    keyword_match, score
from leadloom.functions.text import norm_text


def scores(spark, rows, v=DEFAULT_VOCAB):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, jd string, profile string, role string")
    return [r["s"].asDict(True) for r in
            df.select("i", score("jd", "profile", "role", v).alias("s")).orderBy("i").collect()]


PARTS = [
    ("---", "anything", "", "hard_skills", 25),
    ("kafka snowflake", "kafka", "", "hard_skills", 20),
    ("senior", "senior", "", "experience_level", 15),
    ("senior", "junior", "", "experience_level", 5),
    ("nothing", "junior", "", "experience_level", 10),
    ("junior manager", "manager", "", "experience_level", 15),
    ("phd", "phd", "", "education", 10),
    ("phd", "none", "", "education", 4),
    ("none", "phd", "", "education", 8),
    ("statistics", "statistics", "", "education", 7),
    ("x", "built kanban", "", "soft_skills", 3),
    ("x", "45% 3x $5 50k 20+ 500000", "", "quantified", 10),
    ("x", "data here", "The Data Engineer", "title_match", 5),
    ("x", "data here", "", "title_match", 5),
    ("x", "data here", "  ", "title_match", 0),
]


def test_parts(spark):
    got = scores(spark, [row[:3] for row in PARTS])
    assert [g["breakdown"][row[3]] for g, row in zip(got, PARTS)] == [row[4] for row in PARTS]


def test_bands(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate((85, 84, 75, 65, 50, 49, 80))],
                               "i int, n int")
    rows = df.orderBy("i").select(grade("n").alias("g"), advice("n").alias("a")).collect()
    assert [r["g"] for r in rows] == ["A", "B", "B", "C", "D", "F", "B"]
    assert [r["a"].split()[0] for r in rows] == [
        "Strong", "Strong", "Good", "Good", "Moderate", "Weak", "Strong"]


def test_keywords_are_substrings_and_hyphens_never_match(spark):
    df = spark.createDataFrame([("Real-time scikit-learn with Google",)], "x string")
    row = df.select(norm_text("x").alias("t")).select(
        keyword_match("t", ("go", "real-time", "scikit-learn")).alias("m"))
    out = row.select("m", keyword_gap("m", ("go", "real-time", "scikit-learn")).alias("g")).first()
    assert out["m"] == ["go"] and out["g"] == ["real-time", "scikit-learn"]


def test_hand_computed_totals(spark):
    """Parts added up by hand: skills + soft + level + education + quantity + title.

    The one-letter skill ``r`` is in airflow and in senior.
    """
    rows = [
        # 3 of 5 skills 24, no soft word 0, no level asked 10, no degree asked 8, none 0, no role 5
        ("kafka snowflake airflow tableau", "airflow kafka", ""),
        # no skill asked 25, nothing else asked or offered
        ("---", "---", ""),
        # 1 of 2 skills 20, level asked and not offered 5, degree asked and missing 4, role words missing 0
        ("kafka senior phd", "kafka", "Zebra Keeper"),
        # 1 of 2 skills 20, level on both sides 15, degree on both sides 10, one of two role words 5
        ("snowflake senior phd", "senior phd zebra", "Zebra Keeper")]
    got = scores(spark, rows)
    assert [g["score"] for g in got] == [47, 48, 29, 50]
    assert [g["grade"] for g in got] == ["F", "F", "F", "D"]
    assert got[0]["matched_keywords"] == ["airflow", "kafka", "r"]
    assert got[0]["missing_keywords"] == ["snowflake", "tableau"]
    assert got[3]["matched_keywords"] == ["r"] and got[3]["missing_keywords"] == ["snowflake"]


def test_smoke_listing(spark):
    jd = ("Senior Data Engineer, Python, Apache Spark, Airflow, AWS (S3, EMR), Kafka, dbt, SQL, "
          "Snowflake, 5+ years experience. Master's preferred. Build scalable data pipelines.")
    profile = ("Data Engineer with Python, Spark, Airflow and SQL. Built pipelines for 500000 rows, "
               "cut cost 35%. Master of Science.")
    (got,) = scores(spark, [(jd, profile, "Senior Data Engineer")])
    assert 0 <= got["score"] <= 100 and got["grade"] in "ABCDF" and got["breakdown"]


def test_empty_vocabulary(spark):
    (got,) = scores(spark, [("a", "b", "")], ScoreVocab(hard=()))
    assert got["breakdown"]["hard_skills"] == 25 and got["matched_keywords"] == []
