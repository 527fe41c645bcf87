"""Scoring jobs: every document against the profile of its variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions.render import list_line
from leadloom.functions.scoring import DEFAULT_VOCAB, ScoreVocab, demand_features, \
    profile_features, score_parts, score_struct
from leadloom.functions.text import norm_text
from leadloom.operators.ranking import ranked
from leadloom.session import lookup


def score_docs(docs: DataFrame, profiles: DataFrame, text: str = "text", role: str = "role",
               variant: str = "variant", v: ScoreVocab = DEFAULT_VOCAB,
               spread: list[str] | None = None, default: str | None = None) -> DataFrame:
    """Add the struct ``score`` to every document.

    ``profiles`` has one row (variant, text) per variant. A document whose variant is
    NULL or has no profile is scored against the profile of the variant ``default``, or
    against an empty one if there is none; no document is left out. Texts are normalised
    and reduced to features before the join, so the join carries a few keywords
    instead of whole documents. Variants are few and uneven; the join is salted
    by ``spread`` so that it also holds when profiles are not broadcast.
    """
    columns = [c for c in docs.columns if c != text]
    wanted = docs.select(*columns, norm_text(text).alias("_norm"))
    wanted = wanted.select(*columns, demand_features("_norm", v).alias("_d"))
    offered = profiles.select(variant, F.col("text").alias("_raw"), norm_text("text").alias("_norm"))
    offered = offered.select(variant, profile_features("_raw", "_norm", v).alias("_p"))
    joined = lookup(wanted, offered, [variant], "left", spread)
    blank_profile = profile_features(F.lit(""), F.lit(""), v)
    if default is not None:
        spare = offered.where(F.col(variant) == default).agg(F.first("_p"))
        blank_profile = F.coalesce(spare.scalar(), blank_profile)
    joined = joined.withColumn("_p", F.coalesce("_p", blank_profile))
    parts = joined.select(*columns, score_parts("_d", "_p", role, v).alias("_parts"))
    return parts.select(*columns, score_struct("_parts").alias("score"))


def flat_scores(scored: DataFrame, *keys: str) -> DataFrame:
    """The score struct as plain columns, lists joined with ', '."""
    b = F.col("score.breakdown")
    return scored.select(
        *keys, F.col("score.score").alias("score"), F.col("score.grade").alias("grade"),
        F.col("score.recommendation").alias("recommendation"),
        *[b[n].alias(n) for n in ("hard_skills", "soft_skills", "experience_level", "education",
                                  "quantified", "title_match", "n_matched", "n_required",
                                  "n_soft", "n_verbs", "n_quantity")],
        F.array_join("score.matched_keywords", ", ").alias("matched_keywords"),
        F.array_join("score.missing_keywords", ", ").alias("missing_keywords"))


def _best(scored: DataFrame, key: str) -> list[Column]:
    return [F.col("score.score").desc(), F.col(key)]


def topk_scored(scored: DataFrame, k: int = 20, threshold: int = vocab.DEFAULT_THRESHOLD,
                key: str = "id", company: str = "company", role: str = "role") -> DataFrame:
    """The best ``k`` above the threshold with rank and list line; ties by ``key``.

    The threshold is applied to the best ``k``, which are the same rows: it is on what they are ordered
    by. As a filter before, it would have every score computed twice.
    """
    top = ranked(scored, _best(scored, key), k).where(F.col("score.score") >= threshold)
    s = F.col("score")
    return top.select(
        "rank", key, role, company, s["score"].alias("score"), s["grade"].alias("grade"),
        F.array_join(F.slice(s["missing_keywords"], 1, 5), ", ").alias("missing_keywords"),
        s["recommendation"].alias("recommendation"),
        list_line(F.col("rank"), s["score"], s["grade"], F.col(role), F.col(company),
                  s["missing_keywords"]).alias("line"))
