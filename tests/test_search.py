"""Searching for many words at once: the same hits as one ``contains`` per word, in one pass over the text."""

from pyspark.sql import functions as F

from leadloom.functions.scoring import DEFAULT_VOCAB, demand_features, keyword_match
from leadloom.functions.search import hook
from leadloom.plans.catalog import QUERIES

# overlapping, nested, prefixes of each other, signs, spaces, one and two characters, beyond the BMP, repeated, empty
WORDS = ("go", "golang", "mongodb", "git", "github", "github actions", "r", "", "sr.", "sr ", "a^b", "[x]-", "\\d+", "$5",
         "über", "ción", "\U0001f680go", "\U0001f680", "kk", "kkk", "etl", "vp ", "\n\tq", "git")
TEXTS = [None, "", "g", "go", "gol", "golan", "golangit", "mongodjango", "kk", "k", "xkkk", "github action", "github actions",
         "a^b[x]-\\d+$5", "a\\d", "ddd", "sr", "sr.", "the sr x", "übergo ciónvp", "vp ", "\U0001f680go", "x\U0001f680", "\U0001f680\U0001f680g",
         "\n\tq\n", "etletl", "ggithub github actionsgolang", "café gıt", "kgkgkkgokk"]


def test_hits_equal_contains(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r["i"]: r["m"] for r in df.select("i", keyword_match("t", WORDS).alias("m")).collect()}
    assert got == {i: [w for w in WORDS if t is not None and w in t] for i, t in enumerate(TEXTS)}


def test_every_keyword_alone_and_between_others(spark):
    words = DEFAULT_VOCAB.hard
    texts = [*words, *[a + b for a, b in zip(words, words[1:])], *[w[:-1] for w in words], " ".join(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["hard"] for r in df.select("i", demand_features("t").alias("d")).select("i", "d.hard").collect()}
    assert got == {i: [w for w in words if w in t] for i, t in enumerate(texts)}


def test_a_text_is_passed_over_once_and_scored_once(spark, data_dir):
    plan = QUERIES["topk_scored"](spark, data_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=(?=(") == 1
    assert not [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter") and "least(100" in line]
    few = [w for w in DEFAULT_VOCAB.hard if hook(w) is None]
    assert len(few) * 10 < len(DEFAULT_VOCAB.hard)
