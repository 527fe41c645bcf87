"""Table mutations as pure functions that return the next version."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions.text import is_contaminated, repaired_subject
from leadloom.session import freeze, instant, parse_instant


def last_per_key(delta: DataFrame, key: str, fields: list[str], seq: list[str] | None) -> DataFrame:
    """One row per key: updates are applied in turn, so the last in the order ``seq`` wins.

    Without ``seq`` the greatest row wins, which is some fixed order. Folded by a combining
    aggregate, so a key that is updated very often shrinks before the shuffle.
    """
    row = F.struct(*[F.col(c) for c in (seq or [])], *[F.col(c).alias(f"_v_{c}") for c in fields])
    folded = delta.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("_r"))
    return folded.select(key, *[F.col(f"_r._v_{c}").alias(c) for c in fields])


def status_transition(jobs: DataFrame, delta: DataFrame, asof: dt.datetime | str,
                      seq: list[str] | None = None) -> DataFrame:
    """Set the status of the listings in ``delta`` (id, status); the last by ``seq`` wins.

    ``applied_at`` is stamped for every status, not only for 'applied'.
    """
    now = instant(parse_instant(asof), jobs.schema["updated_at"].dataType)
    last = last_per_key(delta.where(F.col("status").isNotNull()), "id", ["status"], seq)
    joined = jobs.join(last.withColumnRenamed("status", "_to"), "id", "left")
    hit = F.col("_to").isNotNull()
    return joined.withColumns({
        "applied_status": F.coalesce("_to", "applied_status"),
        "applied_at": F.when(hit, now).otherwise(F.col("applied_at")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }).select(*jobs.columns)


def mark_sent(outreach: DataFrame, ids: DataFrame, asof: dt.datetime | str) -> DataFrame:
    """Mark the rows in ``ids`` (column id) as sent now."""
    now = instant(parse_instant(asof), outreach.schema["sent_at"].dataType)
    joined = outreach.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return joined.withColumns({
        "status": F.when(F.col("_hit"), F.lit("sent")).otherwise(F.col("status")),
        "sent_at": F.when(F.col("_hit"), now).otherwise(F.col("sent_at")),
    }).select(*outreach.columns)


def reset_preview(jobs: DataFrame, outreach: DataFrame) -> DataFrame:
    """What a reset would change: listings by status and sent outreach rows."""
    listing = jobs.where(F.col("applied_status").isin(*vocab.RESET_STATUSES)).select(
        F.lit("job").alias("kind"), "id", F.col("applied_status").alias("status"))
    sent = outreach.where(F.col("status") == "sent").select(
        F.lit("outreach").alias("kind"), "id", "status")
    return listing.unionByName(sent)


def reset_jobs(jobs: DataFrame) -> DataFrame:
    """Back to pending for the reset statuses; ``selected`` is cleared everywhere."""
    hit = F.col("applied_status").isin(*vocab.RESET_STATUSES)
    return jobs.withColumns({
        "applied_status": F.when(hit, F.lit("pending")).otherwise(F.col("applied_status")),
        "selected": F.lit(False)})


def reset_outreach(outreach: DataFrame) -> DataFrame:
    """Sent rows become drafts again; ``sent_at`` stays."""
    return outreach.withColumn(
        "status", F.when(F.col("status") == "sent", F.lit("draft")).otherwise(F.col("status")))


def purge_bad(outreach: DataFrame,
              markers: tuple[str, ...] = vocab.DRAFT_MARKERS) -> DataFrame:
    """All rows but the contaminated cold e-mails."""
    bad = (F.col("outreach_type") == "cold_email") & is_contaminated("body", markers)
    return outreach.where(~F.coalesce(bad, F.lit(False)))


def repair_subjects(outreach: DataFrame) -> DataFrame:
    return outreach.withColumn("subject", repaired_subject("subject"))


def score_writeback(jobs: DataFrame, scores: DataFrame, seq: list[str] | None = None) -> DataFrame:
    """Store ``score`` and ``grade`` on the listings; of several rows per id the last by ``seq``."""
    new = last_per_key(scores, "id", ["score", "grade"], seq).select(
        "id", F.col("score").alias("_score"), F.col("grade").alias("_grade"))
    return jobs.join(new, "id", "left").withColumns({
        "ats_score": F.coalesce("_score", "ats_score"),
        "ats_grade": F.coalesce("_grade", "ats_grade")}).select(*jobs.columns)


def fk_orphans(child: DataFrame, parent: DataFrame, child_key: str,
               parent_key: str = "id") -> DataFrame:
    """Child rows whose non-NULL key has no parent (``parent_key`` is unique)."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def fk_cascade(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str = "id",
               action: str = "cascade") -> DataFrame:
    """Apply a deletion of parents: drop orphans (cascade) or null their key (set_null)."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    if action == "cascade":
        kept = child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_semi")
        return kept.unionByName(child.where(F.col(child_key).isNull())).select(*child.columns)
    if action != "set_null":
        raise ValueError(f"unknown action {action!r}")
    found = keys.withColumn("_found", F.lit(True))
    # rows without a key would all meet in one partition of the outer join
    joined = child.where(F.col(child_key).isNotNull()).join(found, child_key, "left")
    nulled = joined.withColumn(child_key, F.when(F.col("_found"), F.col(child_key)))
    return nulled.select(*child.columns).unionByName(child.where(F.col(child_key).isNull()))


class ForeignKey(NamedTuple):
    child: str
    key: str
    parent: str
    action: str  # cascade or set_null


FOREIGN_KEYS = (
    ForeignKey("contacts", "job_id", "jobs", "set_null"),
    ForeignKey("tailored_docs", "job_id", "jobs", "cascade"),
    ForeignKey("outreach", "job_id", "jobs", "cascade"),
    ForeignKey("outreach", "contact_id", "contacts", "cascade"))


def _parents_first(root: str, keys: tuple[ForeignKey, ...]) -> list[str]:
    """The tables that a deletion in ``root`` can reach, each after all its parents among them."""
    reached, grown = {root}, True
    while grown:
        more = {k.child for k in keys if k.parent in reached} - reached
        reached, grown = reached | more, bool(more)
    order: list[str] = []
    while len(order) < len(reached):
        free = sorted(t for t in reached - set(order)
                      if all(k.parent in order for k in keys if k.child == t and k.parent in reached))
        if not free:
            raise ValueError(f"keys form a cycle among {sorted(reached - set(order))}")
        order += free
    return order


def delete_cascade(tables: dict[str, DataFrame], root: str, ids: DataFrame,
                   keys: tuple[ForeignKey, ...] = FOREIGN_KEYS) -> dict[str, DataFrame]:
    """Delete the rows of ``root`` with these ids (column id) and all that hangs on them, through every level.

    Tables are taken parents first. What goes on to the next level are only the ids of deleted rows, written once
    so that their number is known: a short list is broadcast and the child is not shuffled. Keys
    that were already without a parent stay; rows without a key are not moved.
    """
    keys = tuple(k for k in keys if k.child in tables and k.parent in tables)
    out, gone = dict(tables), {}
    for name in _parents_first(root, keys):
        rows = tables[name]
        cascades = [k for k in keys if k.child == name and k.parent in gone and k.action == "cascade"]
        lost = ids.select("id") if name == root else None
        for k in cascades:
            mine = rows.join(gone[k.parent].withColumnRenamed("id", k.key), k.key, "left_semi").select("id")
            lost = mine if lost is None else lost.unionByName(mine)
        if lost is not None and any(k.parent == name for k in keys):
            gone[name] = freeze(lost.where("id is not null").distinct(), f"gone-{name}")
        kept = rows
        if name == root:
            kept = kept.join(gone[name] if name in gone else ids.select("id").distinct(), "id", "left_anti")
        for k in keys:
            if k.child != name or k.parent not in gone:
                continue
            parents, without = gone[k.parent].withColumnRenamed("id", k.key), kept.where(F.col(k.key).isNull())
            keyed = kept.where(F.col(k.key).isNotNull())
            if k.action == "cascade":
                keyed = keyed.join(parents, k.key, "left_anti")
            elif k.action == "set_null":
                keyed = keyed.join(parents.withColumn("_gone", F.lit(True)), k.key, "left").withColumn(
                    k.key, F.when(F.col("_gone").isNull(), F.col(k.key)))
            else:
                raise ValueError(f"unknown action {k.action!r}")
            kept = keyed.select(*rows.columns).unionByName(without.select(*rows.columns))
        out[name] = kept.select(*rows.columns)
    return out
