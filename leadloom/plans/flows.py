"""End-to-end flows composed from the operators, each one lazy plan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.classify import classify_role
from leadloom.functions.text import default_text
from leadloom.operators.filters import actionable_contacts, pending_jobs
from leadloom.operators.link import substring_link
from leadloom.operators.merge import merge_jobs
from leadloom.operators.outreach import prompt_table, todo
from leadloom.operators.score import score_docs
from leadloom.session import freeze
from leadloom.sources.tables import union_sources


def ingest(old: DataFrame, listings: list[DataFrame], sponsors: DataFrame,
           asof: dt.datetime | str, seq: list[str]) -> DataFrame:
    """Union the sources, link them to sponsors and upsert them by URL.

    Listings are written once before the link, which reads them twice: they are
    far smaller than the pages they were cut from.
    """
    found = freeze(union_sources(*listings), "listings")
    linked = substring_link(found, sponsors, "company", "name", spread=seq)
    return merge_jobs(old, linked, asof, seq)


def score_pending(jobs: DataFrame, profiles: DataFrame, default: str = "data") -> DataFrame:
    """Score the pending sponsor listings against the profile of their role, else the default's."""
    docs = pending_jobs(jobs).select(
        "id", "company", "role", classify_role("role").alias("variant"),
        default_text("description", "role", "company").alias("text"))
    return score_docs(docs, profiles, spread=["id"], default=default)


def prompts(jobs: DataFrame, docs: DataFrame, contacts: DataFrame, profiles: DataFrame,
            sender: str) -> DataFrame:
    """E-mail prompts of pending listings that have no document yet."""
    waiting = todo(pending_jobs(jobs), docs.select(F.col("job_id").alias("id")), "id")
    keyed = waiting.select("id", "company", "role", "description",
                           classify_role("role").alias("variant"))
    return prompt_table(keyed, actionable_contacts(contacts).drop("company"), profiles, sender)
