"""The registered queries of this package, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import (decontam, dedup, filteraudit, hardneg, linededup, mixing, neardup, pii, quality, sharding,
                          tokens, toxicity, urlfilter)
from leadloom.llm.common import crc32_of_id, table

VOCABULARY = "byte_bpe_50k.json"
PII_KEY = "set a secret of your own here"
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, source, md5('17' || doc_id) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
s AS (
  SELECT source, source_size, 3 * source_size::DOUBLE AS cap,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM n GROUP BY source)),
b AS (SELECT sum(source_size)::DOUBLE AS budget, sum(weight) AS weights FROM s),
f AS (
  SELECT *, cap / weight AS fill, sum(cap) OVER w AS caps, sum(weight) OVER w AS upto_weight
  FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT f.*, budget, caps + fill * (weights - upto_weight) < budget AS capped FROM f, b),
v AS (
  SELECT (any_value(budget) - coalesce(sum(cap) FILTER (capped), 0)) / sum(weight) FILTER (NOT capped) AS level
  FROM c),
t AS (
  SELECT source, source_size, weight, budget,
         CASE WHEN capped THEN cap ELSE least(cap, weight * level) END AS target
  FROM c, v),
q AS (
  SELECT n.*, t.source_size, t.weight, t.target, t.budget,
         sum(size) OVER (PARTITION BY n.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (ORDER BY n.source NULLS LAST, h, doc_id, size) AS pos
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT pos, size, budget, pass, (pass * source_size + upto)::DOUBLE / weight AS finish
  FROM q, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0),
k AS (
  SELECT pos, budget, sum(size) OVER (ORDER BY finish, pos, pass ROWS UNBOUNDED PRECEDING) AS words FROM p),
g AS (SELECT pos, count(*) AS copies FROM k WHERE words <= budget GROUP BY pos)
SELECT doc_id, size, source_size, target, (coalesce(copies, 0) * size)::BIGINT AS taken, source,
       coalesce(copies, 0) AS copies
FROM q LEFT JOIN g USING (pos)
"""


@query("op1_mix_sources", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare
  FROM documents),
k AS (
  SELECT doc_id, sha256(bare) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY bare) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k
"""


@query("op5_exact_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op10_hilbert_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve")


@query("op6_minmax_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents"), width=2, percent=80)


@query("op4_quality_discriminant")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc32_of_id() % 3 == 1, F.lit(False))
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_toxicity_noisy_channel")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc32_of_id() % 5 == 0, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score_toxicity(docs, model, "score").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_elias_fano_tokens")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query("op2_simhash_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query("op7_surrogates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(table(spark, sf_dir, "documents"), key=PII_KEY)


@query("op8_link_graph_url_filter")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
s AS (SELECT r, doc_id, string_split(text, chr(10)) AS lines FROM t),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (
  SELECT k.*, f.first IS NOT NULL AND doc_id IS DISTINCT FROM f.first AS gone
  FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


@query("op11_line_dedup", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
c AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
b AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad
  FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(w.text, '[A-Z]')) > 5 * length(w.text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails, count(*) AS n
  FROM w JOIN c ON w.text = c.text LEFT JOIN b ON w.doc_id = b.doc_id GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM l p, l q, l r, l s, l t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
s AS (
  SELECT filter_order, step, filter_order[step] AS filter, filter_order[:step - 1] AS earlier
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
a AS (
  SELECT *, contains(fails, filter) AS hit, length(translate(fails, earlier, '')) < length(fails) AS gone
  FROM m, s),
g AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept,
         coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = filter), 0) AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0) AS good_lost,
         coalesce(sum(n) FILTER (NOT gone AND hit AND bad), 0) AS toxic_lost
  FROM a GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM g
"""


@query("op12_filter_audit", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM r WHERE vec_id % 50 = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM a, r WHERE a.vec_id <> r.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"))
