"""Keyed upserts as pure functions of the old table and a delta.

A row-at-a-time upsert is a fold over (old, delta in arrival order). Every rule
in it is associative (maximum, first row, last non-NULL value), so the delta is
first folded to one row per key by a combining aggregate; a key that is repeated
very often shrinks before the shuffle. The folded delta is written once, so its
size is known: a small one is broadcast to the old table, which is then neither
shuffled nor sorted, and a large one meets it in a sort-merge join on unique keys.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import schemas
from leadloom.functions.text import blank
from leadloom.operators.ranking import number_rows
from leadloom.session import freeze, instant, parse_instant


COMPANY_TEXTS = ("h1b_source", "domain")
JOB_FIRST = ("company", "role", "source", "location")


def _last(c: str, seq: Column, nullif_empty: bool) -> Column:
    """Last non-NULL (with ``nullif_empty``: non-empty) value of a delta."""
    usable = ~blank(c) if nullif_empty else F.col(c).isNotNull()
    return F.max_by(F.col(c), F.when(usable, seq))


def _new_text(c: str, nullif_empty: bool) -> Column:
    """Stored text after the merge, from the old column and the folded delta."""
    if not nullif_empty:
        return F.coalesce(f"_last_{c}", c).alias(c)
    return F.coalesce(f"_last_{c}", F.nullif(c, F.lit("")), c, f"_any_{c}").alias(c)


def _added(folded: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The folded rows whose key is not in the old table.

    The keys that are in both come from a semi join in the direction that can
    broadcast the delta; only the key column of the old table is read for it.
    """
    known = old.select(key).join(folded.select(key), key, "left_semi")
    return folded.join(known, key, "left_anti")


def _with_ids(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New rows with the ids that follow the greatest id of the old table, in the order of ``key``.

    Only the new rows are sorted and numbered; of the old table only the id is read.
    """
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("_top"))
    numbered = number_rows(new, [key], "_no").select("*", top.scalar().alias("_top"))
    return numbered.withColumn("id", F.col("_top") + F.col("_no")).drop("_no", "_top")


def _completed(new: DataFrame, old: DataFrame, defaults: dict) -> DataFrame:
    """New rows with all columns of the old table: defaults, else NULL, where they have none."""
    missing = {f.name: F.lit(defaults.get(f.name)).cast(f.dataType)
               for f in old.schema.fields if f.name not in new.columns}
    return new.withColumns(missing).select(*old.columns) if missing else new.select(*old.columns)


def fold_companies(delta: DataFrame, seq: list[str], nullif_empty: bool = False) -> DataFrame:
    """The delta as one row per name, in the order ``seq``; rows without a name are dropped."""
    order = F.struct(*seq)
    return delta.where(F.col("name").isNotNull()).groupBy("name").agg(
        F.max("h1b_confirmed").alias("_flag"), F.max("lca_count").alias("_count"),
        *[_last(c, order, nullif_empty).alias(f"_last_{c}") for c in COMPANY_TEXTS],
        *[F.max(c).alias(f"_any_{c}") for c in COMPANY_TEXTS])


def fold_jobs(delta: DataFrame, seq: list[str], nullif_empty: bool = False) -> DataFrame:
    """The delta as one row per URL, in the order ``seq``; rows without a URL are dropped."""
    order = F.struct(*seq)
    return delta.where(~blank("jd_url")).groupBy("jd_url").agg(
        F.min_by(F.struct(*JOB_FIRST), order).alias("_f"),
        F.max("h1b_confirmed").alias("_flag"),
        _last("description", order, nullif_empty).alias("_last_description"),
        F.max("description").alias("_any_description"))


def fold_job_folds(folds: DataFrame, seq: list[str]) -> DataFrame:
    """Folds of several batches as one row per URL; ``seq`` orders the batches."""
    order = F.struct(*seq)
    return folds.groupBy("jd_url").agg(
        F.min_by("_f", order).alias("_f"), F.max("_flag").alias("_flag"),
        F.max_by("_last_description", F.when(F.col("_last_description").isNotNull(), order))
        .alias("_last_description"),
        F.max("_any_description").alias("_any_description"))


def _company_rules(nullif_empty: bool, now: Column) -> tuple[dict, dict]:
    """Columns of a name that was there, and of a new one, from the old row and the fold."""
    changed = {"h1b_confirmed": F.greatest("h1b_confirmed", "_flag"), "lca_count": F.greatest("lca_count", "_count"),
               **{c: _new_text(c, nullif_empty) for c in COMPANY_TEXTS}}
    added = {"h1b_confirmed": F.col("_flag"), "lca_count": F.col("_count"), "created_at": now,
             **{c: F.coalesce(f"_last_{c}", f"_any_{c}") for c in COMPANY_TEXTS}}
    return changed, added


def _job_rules(nullif_empty: bool, now: Column) -> tuple[dict, dict]:
    hit = F.col("_flag").isNotNull() | F.col("_f").isNotNull()
    changed = {"description": _new_text("description", nullif_empty),
               "h1b_confirmed": F.greatest("h1b_confirmed", "_flag"),
               "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    added = {**{c: F.col(f"_f.{c}") for c in JOB_FIRST}, "applied_status": F.lit("pending"),
             "description": F.coalesce("_last_description", "_any_description"),
             "h1b_confirmed": F.col("_flag"), "created_at": now, "updated_at": now}
    return changed, added


def _two_parts(old: DataFrame, folded: DataFrame, key: str, rules: tuple[dict, dict], defaults: dict,
               with_ids: bool) -> DataFrame:
    """Old rows with their changes, and the new rows: a small delta is broadcast."""
    changed, added = rules
    kept = old.join(folded, key, "left").select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in old.columns])
    new = _added(folded, old, key).select(key, *[e.alias(c) for c, e in added.items()])
    if with_ids:
        new = _with_ids(new, old, key)
    return kept.unionByName(_completed(new, old, defaults))


def _one_pass(old: DataFrame, folded: DataFrame, key: str, rules: tuple[dict, dict], defaults: dict,
              buckets: int) -> DataFrame:
    """Old and new rows out of one full outer join, which a table stored by its key enters as it is.

    The delta is dealt into the table's number of buckets last, for Spark keeps the larger of two
    partitionings and would otherwise shuffle a table with few buckets.

    Of the new keys only the key is sorted and numbered; finding them reads one more time
    the key column of the old table, again without moving it.
    """
    changed, added = rules
    keys = folded.select(key).join(old.select(key), key, "left_anti")
    numbered = _with_ids(keys, old, key).select(key, F.col("id").alias("_id"))
    delta = folded.join(numbered, key, "left").repartition(buckets, key)
    both = old.withColumn("_old", F.lit(True)).join(delta, key, "full_outer")
    is_old = F.col("_old").isNotNull()

    def column(f) -> Column:
        if f.name == key:
            return F.col(key)
        new = F.col("_id") if f.name == "id" else added.get(f.name, F.lit(defaults.get(f.name)))
        return F.when(is_old, changed.get(f.name, F.col(f.name))).otherwise(new.cast(f.dataType)).alias(f.name)

    return both.select(*[column(f) for f in old.schema.fields])


def merge_companies(old: DataFrame, delta: DataFrame, asof: dt.datetime | str,
                    seq: list[str], nullif_empty: bool = False, with_ids: bool = True) -> DataFrame:
    """Upsert on ``name``: greatest flag and count, last non-NULL source and domain.

    ``seq`` orders the delta rows; rows without a name are dropped, for a NULL name could
    never be found again. An empty text counts as a value and replaces a stored one unless
    ``nullif_empty`` is set. A NULL count is skipped (SQL's two-argument MAX in some
    engines would make the result NULL). Every column of the old table is kept. New
    names get the next ids in name order; with ``with_ids`` off their id is NULL.
    """
    now = instant(parse_instant(asof), old.schema["created_at"].dataType)
    folded = freeze(fold_companies(delta, seq, nullif_empty), "company-delta")
    return _two_parts(old, folded, "name", _company_rules(nullif_empty, now), {}, with_ids)


def merge_jobs(old: DataFrame, delta: DataFrame, asof: dt.datetime | str, seq: list[str],
               nullif_empty: bool = False, with_ids: bool = True) -> DataFrame:
    """Upsert on ``jd_url``: last non-NULL description, greatest flag; every other column of
    the old table keeps the version that came first. ``seq`` orders the delta rows; rows
    without a URL are dropped. New listings get the next ids in URL order (NULL with
    ``with_ids`` off), the status pending and the defaults of the added columns."""
    now = instant(parse_instant(asof), old.schema["created_at"].dataType)
    folded = freeze(fold_jobs(delta, seq, nullif_empty), "job-delta")
    return _two_parts(old, folded, "jd_url", _job_rules(nullif_empty, now), schemas.JOBS_ADDED_DEFAULTS, with_ids)


def merge_companies_stored(old: DataFrame, delta: DataFrame, asof: dt.datetime | str, seq: list[str],
                           buckets: int, nullif_empty: bool = False) -> DataFrame:
    """:func:`merge_companies` for an old table that is stored by ``name`` (see ``sources.keyed``) and a
    delta of any size: the old table is neither shuffled nor read twice as a whole."""
    now = instant(parse_instant(asof), old.schema["created_at"].dataType)
    folded = freeze(fold_companies(delta, seq, nullif_empty), "company-delta")
    return _one_pass(old, folded, "name", _company_rules(nullif_empty, now), {}, buckets)


def merge_job_folds(old: DataFrame, folded: DataFrame, asof: dt.datetime | str, buckets: int,
                    nullif_empty: bool = False) -> DataFrame:
    """The next version of a listing table stored by ``jd_url`` from the rows of :func:`fold_jobs`."""
    now = instant(parse_instant(asof), old.schema["created_at"].dataType)
    return _one_pass(old, folded, "jd_url", _job_rules(nullif_empty, now), schemas.JOBS_ADDED_DEFAULTS, buckets)


def merge_jobs_stored(old: DataFrame, delta: DataFrame, asof: dt.datetime | str, seq: list[str], buckets: int,
                      nullif_empty: bool = False) -> DataFrame:
    """:func:`merge_jobs` for an old table that is stored by ``jd_url`` and a delta of any size."""
    return merge_job_folds(old, freeze(fold_jobs(delta, seq, nullif_empty), "job-delta"), asof, buckets, nullif_empty)


def seed_companies(names: DataFrame, source: str, lca_count: int = 100) -> DataFrame:
    """Delta rows for a list of known sponsor names (column ``name``)."""
    return names.select(
        F.lit(None).cast("bigint").alias("id"), "name", F.lit(True).alias("h1b_confirmed"),
        F.lit(source).alias("h1b_source"), F.lit(lca_count).cast("bigint").alias("lca_count"),
        F.lit("").alias("domain"), F.lit(None).cast("timestamp").alias("created_at"))


def insert_ignore(old: DataFrame, delta: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """Add the delta rows whose key is new; the first of equal keys wins."""
    columns = old.columns
    rest = [c for c in columns if c != key]
    first = delta.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*seq)).alias("_r"))
    folded = freeze(first.select(key, "_r.*"), "insert-delta")
    return old.unionByName(_added(folded, old, key).select(*columns))


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
