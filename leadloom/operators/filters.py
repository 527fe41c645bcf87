"""Row filters and point lookups.

Each is a plain predicate on stored columns, so Parquet scans see it as a pushed
filter and read only the columns that the caller keeps.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions.text import blank, contains_any, is_contaminated
from leadloom.session import instant, parse_instant


def job_by_id(jobs: DataFrame, job_id: int) -> DataFrame:
    return jobs.where(F.col("id") == job_id)


def pending_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where((F.col("applied_status") == "pending") & F.col("h1b_confirmed"))


def contacts_for_job(contacts: DataFrame, job_id: int) -> DataFrame:
    return contacts.where(F.col("job_id") == job_id)


def status_in(df: DataFrame, values: tuple[str, ...] = vocab.RESET_STATUSES,
              column: str = "applied_status") -> DataFrame:
    return df.where(F.col(column).isin(*values))


def _time_column(df: DataFrame, name: str):
    return F.col(name), df.schema[name].dataType


def events_on_day(log: DataFrame, day: dt.date | str, ts: str = "created_at") -> DataFrame:
    """Events of one UTC day, newest first. A range on the stored column, so it is pushed down."""
    start = dt.datetime.combine(dt.date.fromisoformat(str(day)), dt.time())
    c, dtype = _time_column(log, ts)
    return log.where((c >= instant(start, dtype))
                     & (c < instant(start + dt.timedelta(days=1), dtype))).orderBy(c.desc())


def fresh(df: DataFrame, ts: str, hours: int | None, asof: dt.datetime | str) -> DataFrame:
    """Rows at most ``hours`` old; None or 0 keeps everything."""
    if not hours:
        return df
    c, dtype = _time_column(df, ts)
    return df.where(c >= instant(parse_instant(asof) - dt.timedelta(hours=hours), dtype))


def whole_days(hours: int) -> int:
    """Hours as whole days, at least one."""
    return max(1, hours // 24)


def level_filter(df: DataFrame, column: str,
                 levels: tuple[int, ...] = vocab.MID_LEVELS) -> DataFrame:
    return df.where(F.col(column).isin(*levels))


def bad_subjects(outreach: DataFrame) -> DataFrame:
    return outreach.where(F.col("subject").startswith("] "))


def bad_bodies(outreach: DataFrame,
               markers: tuple[str, ...] = vocab.DRAFT_MARKERS) -> DataFrame:
    return outreach.where((F.col("outreach_type") == "cold_email")
                          & is_contaminated("body", markers))


def good_samples(outreach: DataFrame) -> DataFrame:
    body = F.col("body")
    return outreach.where(
        (F.col("outreach_type") == "cold_email") & (F.col("status") == "sent") & ~blank(body)
        & ~contains_any(body, vocab.GOOD_SAMPLE_EXCLUDES)
        & ~contains_any(F.lower(body), vocab.GOOD_SAMPLE_EXCLUDES_ANY_CASE))


def actionable_contacts(contacts: DataFrame) -> DataFrame:
    return contacts.where(~blank("email")
                          & F.col("contact_type").isin(*vocab.ACTIONABLE_CONTACT_TYPES))


def above(df: DataFrame, threshold: int = vocab.DEFAULT_THRESHOLD,
          column: str = "score") -> DataFrame:
    return df.where(F.col(column) >= threshold)


def last_day(log: DataFrame, back: int = 0) -> DataFrame:
    """Events of the last day that a table stored by ``day`` holds, or of the day ``back`` days before.

    The day is a scalar subquery over the partition column, so the scan opens only that day's files.
    """
    newest = log.agg(F.max("day").alias("d")).select(F.date_sub("d", back))
    return log.where(F.col("day") == newest.scalar())


def fresh_stored(log: DataFrame, hours: int | None, asof: dt.datetime | str, ts: str = "created_at") -> DataFrame:
    """:func:`fresh` on a table stored by ``day``: days that end before the window are not opened."""
    if not hours:
        return log
    first = (parse_instant(asof) - dt.timedelta(hours=hours)).date()
    return fresh(log, ts, hours, asof).where((F.col("day") >= F.lit(first)) | F.col("day").isNull())
