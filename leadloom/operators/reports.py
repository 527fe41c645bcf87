"""Counts, funnels, ratios and digests.

One pass per table: the counts of a table are conditional counts of one
aggregate. One-row results of several tables are stacked and summed.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions.text import is_contaminated, title_label
from leadloom.operators.filters import events_on_day


def _one_row(*parts: DataFrame) -> DataFrame:
    names = [c for p in parts for c in p.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.sum(c).alias(c) for c in names])


def _n(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def funnel_stats(jobs: DataFrame, outreach: DataFrame) -> DataFrame:
    status = F.col("applied_status")
    return _one_row(
        jobs.agg(F.count("*").alias("total_jobs"), _n(F.col("h1b_confirmed"), "h1b_jobs"),
                 _n(status == "applied", "applied"), _n(status == "interview", "interviews")),
        outreach.agg(_n(F.col("status") == "sent", "emails_sent")))


def dashboard_stats(jobs: DataFrame, outreach: DataFrame, contacts: DataFrame) -> DataFrame:
    status = F.col("applied_status")
    return _one_row(
        jobs.agg(F.count("*").alias("total"), _n(F.col("h1b_confirmed"), "h1b"),
                 _n((status == "pending") & F.col("h1b_confirmed"), "pending"),
                 _n(status == "applied", "applied")),
        outreach.agg(_n(F.col("status") == "sent", "emails"),
                     _n(F.col("status") == "draft", "drafts")),
        contacts.agg(F.count("*").alias("contacts")))


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def daily_digest(log: DataFrame, day: dt.date | str) -> DataFrame:
    """Events of one day by type, the type of the newest event first."""
    counts = events_on_day(log, day).groupBy("event").agg(
        F.count("*").alias("n"), F.max("created_at").alias("last_at"))
    return counts.select(title_label("event").alias("label"), "event", "n", "last_at").orderBy(
        F.col("last_at").desc(), "event")


def digest_text(stats: DataFrame, digest: DataFrame, day: dt.date | str) -> DataFrame:
    """The digest as one text; its input is one row per event type."""
    label = dt.date.fromisoformat(str(day)).strftime("%A, %B %d")
    lines = digest.agg(F.array_sort(F.collect_list(F.struct(
        (-F.unix_micros(F.col("last_at").cast("timestamp"))).alias("o"), "event", "label", "n")
    )).alias("e"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    events = F.transform("e", lambda r: F.concat(
        F.lit("- "), r["label"], F.lit(" x "), r["n"].cast("string")))
    shown = F.when(F.size("e") > 0, events).otherwise(F.array(F.lit("- nothing recorded")))
    stat = stats.select(F.struct("*").alias("s"))
    row = _paired(stat, lines)

    def v(name: str) -> Column:
        return F.col(f"s.{name}").cast("string")

    head = F.array(
        F.lit(f"Digest for {label}"), F.lit(""),
        F.concat(F.lit("Listings "), v("total_jobs"), F.lit(", with sponsor "), v("h1b_jobs")),
        F.concat(F.lit("Applications "), v("applied"), F.lit(", interviews "), v("interviews")),
        F.concat(F.lit("Mails sent "), v("emails_sent")), F.lit(""),
        F.concat(F.lit("Events of the day: "), F.col("total").cast("string")))
    return row.select(F.array_join(F.concat(head, shown), "\n").alias("text"))


def _paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row tables side by side."""
    names = [*a.columns, *b.columns]
    stacked = a.unionByName(b, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])


def match_rate(jobs: DataFrame) -> DataFrame:
    total, hit = F.count("*"), F.count_if(F.col("h1b_confirmed"))
    return jobs.agg(total.alias("total"), hit.alias("h1b"),
                    (hit * 100 / F.greatest(total, F.lit(1))).alias("pct"))


def batch_summary(results: DataFrame, success: Column) -> DataFrame:
    return results.agg(F.count_if(success).alias("success"), F.count("*").alias("total"))


def link_summary(linked: DataFrame, flag: str = "h1b_confirmed") -> DataFrame:
    return linked.agg(F.count_if(F.col(flag)).alias("matched"), F.count("*").alias("total"))


def quality_ratio(outreach: DataFrame,
                  markers: tuple[str, ...] = vocab.DRAFT_MARKERS) -> DataFrame:
    mails = outreach.where(F.col("outreach_type") == "cold_email")
    return mails.agg(F.count_if(is_contaminated("body", markers)).alias("bad"),
                     F.count("*").alias("total"))


def metadata_status_counts(meta: DataFrame) -> DataFrame:
    return (meta.select(F.coalesce("applied_status", F.lit("pending")).alias("status"))
            .groupBy("status").agg(F.count("*").alias("n")))
