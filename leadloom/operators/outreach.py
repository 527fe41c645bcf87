"""Joins over listings, contacts and the outreach ledger.

Filters are applied to each side before its join and only the needed columns are
carried, so a shuffle moves narrow rows. Existence tests are semi or anti joins
and never multiply rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions.render import cut, email_prompt, render_followup, render_prompt, slot_limit
from leadloom.functions.text import blank, default_text, template_no
from leadloom.operators.ranking import cap_per_group
from leadloom.session import instant, lookup, parse_instant


def _drafts(outreach: DataFrame, kind: str) -> DataFrame:
    return outreach.where((F.col("outreach_type") == kind) & (F.col("status") == "draft"))


def due_followups(outreach: DataFrame, jobs: DataFrame, day: int) -> DataFrame:
    """Draft follow-ups that carry the day label, with company and role."""
    drafts = _drafts(outreach, "followup").where(F.col("followup_day") == day)
    names = jobs.select(F.col("id").alias("job_id"), "company", "role")
    return drafts.join(names, "job_id")


def due_followups_by_date(outreach: DataFrame, jobs: DataFrame,
                          asof: dt.datetime | str) -> DataFrame:
    """Draft follow-ups whose day after application has come."""
    applied = jobs.where(F.col("applied_at").isNotNull()).select(
        F.col("id").alias("job_id"), "company", "role", "applied_at")
    due = F.col("applied_at") + F.make_dt_interval(F.col("followup_day"))
    return (_drafts(outreach, "followup").where(F.col("followup_day").isNotNull())
            .join(applied, "job_id")
            .where(due <= instant(parse_instant(asof), jobs.schema["applied_at"].dataType)))


def with_contact(rows: DataFrame, contacts: DataFrame, how: str = "inner") -> DataFrame:
    people = contacts.select(F.col("id").alias("contact_id"), F.col("name").alias("to_name"),
                             F.col("email").alias("to_email"), "contact_type")
    return rows.join(people, "contact_id", how)


def followups_resolved(outreach: DataFrame, jobs: DataFrame, contacts: DataFrame,
                       day: int, sender: str = "") -> DataFrame:
    """Due follow-ups that have an address, with the rendered text."""
    rows = with_contact(due_followups(outreach, jobs, day), contacts).where(~blank("to_email"))
    mail = rows.withColumn("_m", render_followup("company", "role", "followup_day", sender))
    return mail.select("id", "job_id", "contact_id", "to_email",
                       F.col("_m.subject").alias("subject"), F.col("_m.body").alias("body"))


def followups_unresolved(outreach: DataFrame, jobs: DataFrame, contacts: DataFrame,
                         day: int) -> DataFrame:
    """Due follow-ups with no contact or no address."""
    rows = with_contact(due_followups(outreach, jobs, day), contacts, "left")
    return rows.where(blank("to_email"))


def job_emails(outreach: DataFrame, contacts: DataFrame, job_id: int | None = None) -> DataFrame:
    """Cold e-mails with their contact, for one listing or for all."""
    mails = outreach.where(F.col("outreach_type") == "cold_email")
    if job_id is not None:
        mails = mails.where(F.col("job_id") == job_id)
    return with_contact(mails, contacts)


def recent_emails(outreach: DataFrame, contacts: DataFrame, jobs: DataFrame, n: int,
                  ties: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` latest cold e-mails with contact, role and company (a top-k report)."""
    names = jobs.select(F.col("id").alias("job_id"), "company", "role")
    rows = with_contact(outreach.where(F.col("outreach_type") == "cold_email"),
                        contacts).join(names, "job_id")
    return rows.orderBy(F.col("id").desc(), *ties).limit(n)


def gap_report(jobs: DataFrame, contacts: DataFrame) -> DataFrame:
    """Pending sponsor listings without any contact.

    Contact keys are made distinct first: partial aggregates shrink a listing with
    very many contacts before the shuffle, which the join then reuses.
    """
    pending = jobs.where(F.col("h1b_confirmed") & (F.col("applied_status") == "pending")).select(
        F.col("id").alias("job_id"), "company", "jd_url", "role")
    known = contacts.where(F.col("job_id").isNotNull()).select("job_id").distinct()
    return (pending.join(known, "job_id", "left_anti")
            .select("company", "jd_url", "role").distinct().orderBy("company", "jd_url", "role"))


def needs_regen(contacts: DataFrame, outreach: DataFrame) -> DataFrame:
    """Listings that have a contact but no cold e-mail.

    Both id lists are reduced on the map side before the anti join, so a listing
    with very many contacts or e-mails costs one row.
    """
    wanted = contacts.where(F.col("job_id").isNotNull()).select("job_id").distinct()
    mailed = outreach.where(F.col("outreach_type") == "cold_email").select("job_id").distinct()
    return wanted.join(mailed, "job_id", "left_anti")


def send_queue(outreach: DataFrame, jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Listings applied to that have cold e-mail drafts."""
    applied = jobs.where(F.col("applied_status") == "applied").select(F.col("id").alias("job_id"))
    ids = (_drafts(outreach, "cold_email").select("job_id").distinct()
           .join(applied, "job_id", "left_semi"))
    return ids.orderBy("job_id").limit(limit) if limit else ids


def sendable_drafts(outreach: DataFrame, contacts: DataFrame, jobs: DataFrame,
                    require_applied: bool = True) -> DataFrame:
    """Cold e-mail drafts with an address, by default only for applied listings."""
    drafts = _drafts(outreach, "cold_email")
    if require_applied:
        applied = jobs.where(F.col("applied_status") == "applied").select(
            F.col("id").alias("job_id"))
        drafts = drafts.join(applied, "job_id", "left_semi")
    rows = with_contact(drafts, contacts.where(~blank("email")))
    subject = F.coalesce(F.nullif("subject", F.lit("")), F.concat(
        F.lit("Re: "), F.coalesce("contact_type", F.lit("Opportunity"))))
    return rows.withColumn("subject", subject)


def todo(df: DataFrame, done: DataFrame, key: str, force: bool = False,
         spread: list[str] | None = None) -> DataFrame:
    """Rows not processed yet (everything with ``force``). ``spread`` names columns
    that vary within a key, where ``df`` may hold very many rows of one key."""
    if force:
        return df
    return lookup(df, done.select(key).distinct(), [key], "left_anti", spread)


def ready(df: DataFrame, done: DataFrame, key: str,
          spread: list[str] | None = None) -> DataFrame:
    """Rows whose required earlier output exists."""
    return lookup(df, done.select(key).distinct(), [key], "left_semi", spread)


def plan_followups(df: DataFrame, days: tuple[int, ...] = vocab.FOLLOWUP_DAYS) -> DataFrame:
    """One empty follow-up draft per listing, contact and day."""
    return df.select(
        "job_id", "contact_id", F.lit("followup").alias("outreach_type"),
        F.lit("").alias("subject"), F.lit("").alias("body"), F.lit("draft").alias("status"),
        F.explode(F.array(*[F.lit(d) for d in days])).alias("followup_day"))


def fallback_enrich(primary: DataFrame, fallback: DataFrame, key: str = "job_id",
                    dedup: str = "email", order: str = "pos", min_rows: int = 2) -> DataFrame:
    """All primary rows; for keys with fewer than ``min_rows`` of them also the
    fallback rows with an unseen ``dedup`` value, the first of each.

    Both sides are folded once by (key, value): how often a primary row has it and the
    first fallback row with it. Counts per key are summed from the folded rows, so no task
    holds all rows of a large key, and primary rows pass through without a shuffle; only
    the check for full keys is salted.
    """
    columns = primary.columns
    rest = [c for c in columns if c not in (key, dedup, order)]
    row = F.struct(order, *rest)
    both = primary.select(key, dedup, F.lit(1).alias("_p"), F.lit(None).alias("_r")).unionByName(
        fallback.select(key, dedup, F.lit(0).alias("_p"), row.alias("_r")))
    folded = both.groupBy(key, dedup).agg(F.sum("_p").alias("_p"), F.min("_r").alias("_r"))
    full = folded.groupBy(key).agg(F.sum("_p").alias("_n")).where(F.col("_n") >= min_rows).select(key)
    first = folded.where((F.col("_p") == 0) & F.col("_r").isNotNull()).select(key, dedup, "_r.*")
    return primary.unionByName(lookup(first, full, [key], "left_anti", [dedup]).select(*columns))


def _with_profile(rows: DataFrame, profiles: DataFrame, spread: list[str], *kinds: str) -> DataFrame:
    """Rows with the ``profile`` of their variant, as much of it as the prompts of ``kinds`` show.

    Texts are cut before they are joined, so a shuffle moves no character that no prompt shows. There are few
    variants; rows of one are spread over several tasks by the columns ``spread``.
    """
    short = profiles.select("variant", cut(F.col("text"), slot_limit("profile", *kinds)).alias("profile"))
    return lookup(rows, short, ["variant"], "left", spread)


EMAILS = ("email_1", "email_2", "email_3")


def prompt_table(jobs: DataFrame, contacts: DataFrame, profiles: DataFrame,
                 sender: str) -> DataFrame:
    """One e-mail prompt per listing and actionable contact, for batch inference.

    ``jobs`` holds ``variant``; ``profiles`` is one row per variant.
    """
    people = contacts.select("job_id", F.col("id").alias("contact_id"), "name", "title")
    shown = cut(default_text("description", "role", "company"), slot_limit("description", *EMAILS))
    listings = jobs.select(F.col("id").alias("job_id"), "company", "role", "variant", shown.alias("description"))
    rows = _with_profile(people.join(listings, "job_id"), profiles, ["job_id", "contact_id"], *EMAILS)
    number = template_no("job_id")
    slots = {c: F.col(c) for c in ("company", "role", "name", "title", "profile", "description")}
    return rows.select("job_id", "contact_id", number.alias("template"),
                       email_prompt(number, {**slots, "sender": F.lit(sender)}).alias("prompt"))


def referral_prompts(people: DataFrame, profile: DataFrame, sender: str,
                     per_company: int = 3) -> DataFrame:
    """Referral prompts for at most ``per_company`` people of a company."""
    capped = cap_per_group(people, ["company"], ["id", "name"], per_company)
    rows = _with_profile(capped, profile, ["company", "id"], "referral")
    slots = {c: F.col(c) for c in ("company", "role", "name", "title", "profile")}
    return rows.select("company", "id", render_prompt(
        "referral", {**slots, "sender": F.lit(sender)}).alias("prompt"))


def listing_prompts(jobs: DataFrame, profiles: DataFrame, sender: str) -> DataFrame:
    """The two per-listing prompts (bullets and letter)."""
    rows = _with_profile(jobs, profiles, ["id"], "bullets", "letter")
    slots = {"company": F.col("company"), "role": F.col("role"), "profile": F.col("profile"),
             "sender": F.lit(sender),
             "description": default_text("description", "role", "company")}
    kinds = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), render_prompt(k, slots).alias("prompt"))
        for k in ("bullets", "letter")])).alias("_p")
    return rows.select("id", kinds).select("id", "_p.kind", "_p.prompt")
