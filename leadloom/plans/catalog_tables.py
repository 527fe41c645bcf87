"""Joins, upserts, mutations, reports and streams over the outreach tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions.render import FOLLOWUP_BODIES, FOLLOWUP_SUBJECT, PROMPTS
from leadloom.functions.classify import classify_role
from leadloom.functions.sqlfuncs import register_table_functions
from leadloom.operators import filters as P
from leadloom.operators import link as L
from leadloom.operators import maintain as D
from leadloom.operators import merge as G
from leadloom.operators import mutate as M
from leadloom.operators import outreach as O
from leadloom.operators import reports as A
from leadloom.operators.changes import apply_feed, change_feed
from leadloom.operators.ranking import fill_ids, first_per_key
from leadloom.plans.catalog_rows import JOB_LIST, SQL_BAD, sql_removed
from leadloom.plans.registry import ORACLE, query
from leadloom.plans.views import Views, q, sql_first_match, with_views
from leadloom.session import listed_in_tasks, listed_on_driver, scratch_path, small_files
from leadloom.sources import sinks as K
from leadloom.sources.keyed import KeyedTable
from leadloom.sources.payloads import contacts_from_payload
from leadloom.sources.tables import (load_profile, read_by_day, read_metadata_lines, read_table, scan_metadata,
                                     stream_metadata, write_by_day, write_version)
from leadloom.streaming import jobs as S
from leadloom.streaming.ledger import ReleaseLedger
from leadloom.streaming.listings import ListingStore

ASOF = "2002-01-01 00:00:00"
TS = f"TIMESTAMP '{ASOF}'"
SENDER = "A. Sender"

# --- joins ---

_DUE = """SELECT o.id, o.job_id, o.contact_id, o.followup_day, j.company, j.role FROM v_outreach o
    JOIN v_jobs j ON j.id = o.job_id
    WHERE o.outreach_type = 'followup' AND o.status = 'draft' AND {0}"""


@query("due_followups", with_views("v_outreach", "v_jobs", then=_DUE.format("o.followup_day = 7")))
def _(v):
    return O.due_followups(v.outreach(), v.jobs(), 7).select(
        "id", "job_id", "contact_id", "followup_day", "company", "role")


@query("due_followups_by_date", with_views("v_outreach", "v_jobs", then=_DUE.format(
    "j.applied_at + to_days(o.followup_day) <= TIMESTAMP '2000-01-01'")))
def _(v):
    return O.due_followups_by_date(v.outreach(), v.jobs(), "2000-01-01 00:00:00").select(
        "id", "job_id", "contact_id", "followup_day", "company", "role")


_WITH_C = "v_outreach o LEFT JOIN v_contacts c ON c.id = o.contact_id"


def _sql_tables(v: Views) -> None:
    v.jobs().createOrReplaceTempView("leadloom_jobs")
    v.outreach().createOrReplaceTempView("leadloom_outreach")
    v.job_contacts().createOrReplaceTempView("leadloom_contacts")
    v.jobs().select("id", "role", "company", F.col("ats_score").alias("score"), F.col("ats_grade").alias(
        "grade")).createOrReplaceTempView("leadloom_scored")
    register_table_functions(v.spark, "leadloom_jobs", "leadloom_outreach", "leadloom_contacts", "leadloom_scored")


@query("sql_due_followups", ORACLE["due_followups"])
def _(v):
    _sql_tables(v)
    return v.spark.sql("SELECT * FROM due_followups(7)")


@query("sql_due_followups_by_date", ORACLE["due_followups_by_date"])
def _(v):
    _sql_tables(v)
    return v.spark.sql("SELECT * FROM due_followups_by_date(TIMESTAMP '2000-01-01 00:00:00')")


@query("followups_unresolved", with_views("v_outreach", "v_jobs", "v_contacts", then=f"""
       SELECT o.id, o.job_id, o.contact_id, c.email AS to_email FROM {_WITH_C}
       JOIN v_jobs j ON j.id = o.job_id WHERE o.outreach_type = 'followup' AND o.status = 'draft'
       AND o.followup_day = 7 AND coalesce(c.email, '') = ''"""))
def _(v):
    rows = O.followups_unresolved(v.outreach(), v.jobs(), v.contacts(), 7)
    return rows.select("id", "job_id", "contact_id", "to_email")


@query("job_emails", with_views("v_outreach", "v_contacts", then=f"""SELECT o.id, o.job_id, o.status,
       o.subject, c.name AS to_name, c.email AS to_email, c.contact_type FROM {_WITH_C}
       WHERE o.outreach_type = 'cold_email' AND c.id IS NOT NULL AND o.job_id = 42"""))
def _(v):
    return O.job_emails(v.outreach(), v.contacts(), 42).select(
        "id", "job_id", "status", "subject", "to_name", "to_email", "contact_type")


@query("recent_emails", with_views("v_outreach", "v_contacts", "v_jobs", then=f"""SELECT o.id, o.job_id,
       o.status, o.subject, substr(o.body, 1, 600) AS body, c.name AS to_name, j.company, j.role
       FROM {_WITH_C} JOIN v_jobs j ON j.id = o.job_id
       WHERE o.outreach_type = 'cold_email' AND c.id IS NOT NULL
       ORDER BY o.id DESC, o.status, c.name, o.subject NULLS FIRST, o.body NULLS FIRST LIMIT 50"""))
def _(v):
    rows = O.recent_emails(v.outreach(), v.contacts(), v.jobs(), 50,
                           ("status", "to_name", "subject", "body"))
    return rows.select("id", "job_id", "status", "subject", F.substring("body", 1, 600).alias("body"),
                       "to_name", "company", "role")


@query("gap_report", with_views("v_jobs", "v_job_contacts", then="""SELECT DISTINCT company, jd_url, role
       FROM v_jobs j WHERE h1b_confirmed AND applied_status = 'pending' AND NOT EXISTS
       (SELECT 1 FROM v_job_contacts c WHERE c.job_id = j.id)"""))
def _(v):
    return O.gap_report(v.jobs(), v.job_contacts())


@query("sql_gap_report", ORACLE["gap_report"])
def _(v):
    _sql_tables(v)
    return v.spark.sql("SELECT * FROM gap_report()")


@query("sql_pending_jobs", with_views("v_jobs", then="""SELECT id, company, role, jd_url, description FROM v_jobs
       WHERE applied_status = 'pending' AND h1b_confirmed"""))
def _(v):
    _sql_tables(v)
    return v.spark.sql("SELECT * FROM pending_jobs()")


@query("needs_regen", with_views("v_outreach", "v_job_contacts", then="""SELECT DISTINCT job_id
       FROM v_job_contacts c WHERE NOT EXISTS (SELECT 1 FROM v_outreach o
       WHERE o.job_id = c.job_id AND o.outreach_type = 'cold_email')"""))
def _(v):
    return O.needs_regen(v.job_contacts(), v.outreach())


@query("send_queue", with_views("v_outreach", "v_jobs", then="""SELECT DISTINCT o.job_id
       FROM v_outreach o JOIN v_jobs j ON j.id = o.job_id WHERE o.outreach_type = 'cold_email'
       AND o.status = 'draft' AND j.applied_status = 'applied'"""))
def _(v):
    return O.send_queue(v.outreach(), v.jobs())


_SENDABLE = f"""SELECT o.id, o.job_id, c.email AS to_email, o.body, CASE WHEN o.subject = ''
    THEN 'Re: ' || c.contact_type ELSE o.subject END AS subject FROM {_WITH_C}
    {{0}} WHERE o.outreach_type = 'cold_email' AND o.status = 'draft'
    AND coalesce(c.email, '') <> ''"""


@query("sendable_drafts", with_views("v_outreach", "v_contacts", "v_jobs", then=_SENDABLE.format(
    "JOIN v_jobs j ON j.id = o.job_id AND j.applied_status = 'applied'")))
def _(v):
    rows = O.sendable_drafts(v.outreach(), v.contacts(), v.jobs())
    return rows.select("id", "job_id", "to_email", "body", "subject")


@query("sendable_drafts_any", with_views("v_outreach", "v_contacts", then=_SENDABLE.format("")))
def _(v):
    rows = O.sendable_drafts(v.outreach(), v.contacts(), v.jobs(), require_applied=False)
    return rows.select("id", "job_id", "to_email", "body", "subject")


@query("todo_docs", """SELECT doc_id, source FROM documents WHERE doc_id NOT IN
       (SELECT doc_id FROM labels)""")
def _(v):
    return O.todo(v.table("documents").select("doc_id", "source"), v.table("labels"), "doc_id")


@query("ready_docs", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(v):
    return O.ready(v.table("documents").select("doc_id", "source"), v.table("labels"), "doc_id")


def _payloads(v: Views) -> DataFrame:
    key, name = F.col("s_suppkey"), F.col("s_name")
    locked = F.when(key % 3 == 0, F.lit(vocab.LOCKED_EMAIL)).when(key % 3 == 1, F.lit("")) \
        .otherwise(F.concat(name, F.lit("@people.example")))
    mail = F.struct(F.struct(F.array(
        F.struct(F.lit("Ann").alias("first_name"), name.alias("last_name"),
                 F.lit("Talent Acquisition").alias("position"),
                 F.concat(name, F.lit("@mail.example")).alias("value")),
        F.struct(F.lit(None).cast("string").alias("first_name"), name.alias("last_name"),
                 F.lit(None).cast("string").alias("position"),
                 F.when(key % 2 == 0, F.lit("")).otherwise(F.concat(name, F.lit("@x.example")))
                 .alias("value"))).alias("emails")).alias("data"))
    people = F.struct(F.array(F.struct(
        name.alias("name"), locked.alias("email"), F.lit("CTO").alias("title"))).alias("people"))
    return v.table("supplier").select(key.alias("job_id"), F.to_json(mail).alias("mail"),
                                      F.to_json(people).alias("people"))


@query("payload_contacts", f"""
    SELECT s_suppkey AS job_id, 0 AS pos, 'Ann ' || s_name AS name, s_name || '@mail.example' AS email,
      'Talent Acquisition' AS title, 'hr' AS contact_type, 'mail' AS source FROM supplier UNION ALL
    SELECT s_suppkey, 1, s_name, s_name || '@x.example', '', 'other', 'mail' FROM supplier
      WHERE s_suppkey % 2 = 1 UNION ALL
    SELECT s_suppkey, 0, s_name, s_name || '@people.example', 'CTO', 'hiring_manager', 'people'
      FROM supplier WHERE s_suppkey % 3 = 2""")
def _(v):
    rows = _payloads(v)
    return contacts_from_payload(rows, "mail", "mail").unionByName(
        contacts_from_payload(rows, "people", "people"))


@query("fallback_enrich", with_views("v_job_contacts", then="""
    , p AS (SELECT * FROM v_job_contacts WHERE contact_type IN ('hr', 'hiring_manager')),
    f AS (SELECT * FROM v_job_contacts WHERE contact_type NOT IN ('hr', 'hiring_manager')),
    few AS (SELECT f.* FROM f WHERE (SELECT count(*) FROM p WHERE p.job_id = f.job_id) < 2
      AND NOT EXISTS (SELECT 1 FROM p WHERE p.job_id = f.job_id AND p.email = f.email))
    SELECT job_id, pos, name, email, title, contact_type FROM p UNION ALL
    SELECT job_id, pos, name, email, title, contact_type FROM few
    QUALIFY row_number() OVER (PARTITION BY job_id, email ORDER BY pos, name) = 1"""))
def _(v):
    rows = v.job_contacts().select("job_id", "pos", "name", "email", "title", "contact_type", "id")
    first = F.col("contact_type").isin("hr", "hiring_manager")
    out = O.fallback_enrich(rows.where(first), rows.where(~first))
    return out.select("job_id", "pos", "name", "email", "title", "contact_type")


# --- fuzzy link ---

def _sql_linked(removals) -> str:
    return f"""l AS (SELECT *, trim({sql_removed('lower(company)', removals)}) AS n
        FROM v_page_companies), s AS (SELECT trim({sql_removed('lower(name)', removals)}) AS n
        FROM v_sponsors), m AS (SELECT l.*, EXISTS (SELECT 1 FROM s WHERE contains(l.n, s.n)
        OR contains(s.n, l.n)) AS hit FROM l)"""


_LINK = with_views("v_page_companies", "v_sponsors", then=", " + _sql_linked(vocab.COMPANY_REMOVALS)) \
    
_TAG = with_views("v_page_companies", "v_sponsors", then=", " + _sql_linked(vocab.SPONSOR_REMOVALS)) \
    


@query("sponsor_match", _LINK + " SELECT id, company, hit AS h1b_confirmed FROM m")
def _(v):
    return L.substring_link(v.companies_in_pages(), v.sponsors_in_texts(), "company", "name",
                            spread=["id"])


@query("sponsor_match_summary",
       _LINK + " SELECT count(*) FILTER (WHERE hit) AS matched, count(*) AS total FROM m")
def _(v):
    return A.link_summary(L.substring_link(
        v.companies_in_pages(), v.sponsors_in_texts(), "company", "name", spread=["id"]))


@query("tag_linked", _TAG + " SELECT id, company, h1b_confirmed OR hit AS h1b_confirmed FROM m")
def _(v):
    return L.tag_linked(v.companies_in_pages(), v.sponsors_in_texts(), spread=["id"])


@query("sponsor_set", with_views(
    "v_companies", then="SELECT DISTINCT lower(name) AS name FROM v_companies WHERE h1b_confirmed"))
def _(v):
    return L.sponsor_set(v.companies())


# --- upserts ---

_OLD_C = """old AS (SELECT * FROM v_companies WHERE c_nationkey % 2 = 0
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1),
    b AS (SELECT 0 AS d, id AS seq, * EXCLUDE (c_nationkey) FROM old UNION ALL
    SELECT 1, id, * EXCLUDE (c_nationkey) FROM v_companies WHERE c_nationkey % 2 = 1)"""


def _company_sides(v: Views):
    rows, even = v.companies(), F.col("c_nationkey") % 2 == 0
    old = first_per_key(rows.where(even).drop("c_nationkey"), ["name"], ["id"])
    return old, rows.where(~even).drop("c_nationkey").withColumn("seq", F.col("id")), even


def _merged_companies(v: Views, **kw) -> DataFrame:
    old, delta, _ = _company_sides(v)
    return G.merge_companies(old, delta, ASOF, ["seq"], **kw)


_NEXT_ID = """coalesce(min(id) FILTER (d = 0), (SELECT max(id) FROM old) + row_number() OVER (
    PARTITION BY min(id) FILTER (d = 0) IS NULL ORDER BY {0}))"""


def _companies_sql(text_rule: str) -> str:
    def last(c: str) -> str:
        return text_rule.format(c)
    return with_views("v_companies", then=f", {_OLD_C} SELECT name, {_NEXT_ID.format('name')} AS id, "
                      f"bool_or(h1b_confirmed) AS h1b_confirmed, max(lca_count) AS lca_count, "
                      f"{last('h1b_source')} AS h1b_source, {last('domain')} AS domain, "
                      f"coalesce(min(created_at) FILTER (d = 0), {TS}) AS created_at "
                      f"FROM b GROUP BY name")


@query("upsert_companies", _companies_sql(
    "arg_max({0}, d * 1000000000000 + seq) FILTER ({0} IS NOT NULL)"))
def _(v):
    return _merged_companies(v)


@query("upsert_companies_keep_text", _companies_sql(
    "coalesce(arg_max({0}, d * 1000000000000 + seq) FILTER ({0} <> ''), max({0}))"))
def _(v):
    return _merged_companies(v, nullif_empty=True)


@query("upsert_companies_filled", with_views("v_companies", then=f""", {_OLD_C},
    k AS (SELECT name, min(id) FILTER (d = 0) AS id FROM b GROUP BY name)
    SELECT name, coalesce(id, (SELECT max(id) FROM k) + row_number() OVER (
      PARTITION BY id IS NULL ORDER BY name)) AS id FROM k"""))
def _(v):
    return fill_ids(_merged_companies(v, with_ids=False).select("name", "id"), "id", ["name"])


_SPLIT = "TIMESTAMP '1998-01-01'"


def _jobs_sql(flag: str = "h1b_confirmed", group: str = "0", views: tuple = ("v_jobs",), more: str = "") -> str:
    """Listings after the upsert; new ones get their ids by ``group``, then by URL."""
    next_id = _NEXT_ID.format("min(g), jd_url")
    return with_views(*views, then=f""" {more}, old AS (SELECT * REPLACE (id % 100 AS ats_score,
        CASE WHEN id % 3 = 0 THEN 'B' END AS ats_grade) FROM v_jobs
      WHERE created_at < {_SPLIT} QUALIFY row_number() OVER (PARTITION BY jd_url
        ORDER BY created_at, id) = 1),
    b AS (SELECT 0 AS d, 0 AS g, created_at AS seen, * FROM old
      UNION ALL SELECT 1, {group}, created_at, id, company, role, jd_url, source, location, description,
        {flag}, 'pending', NULL, {TS}, {TS}, 0, NULL, false
      FROM v_jobs WHERE created_at >= {_SPLIT}),
    r AS (SELECT *, row_number() OVER (PARTITION BY jd_url ORDER BY d, seen, id) AS rn FROM b)
    SELECT jd_url, {next_id} AS id, arg_min(company, rn) AS company,
      arg_min(role, rn) AS role, arg_min(source, rn) AS source, arg_min(location, rn) AS location,
      arg_min(applied_status, rn) AS applied_status,
      max(CASE WHEN rn = 1 THEN applied_at END) AS applied_at,
      arg_min(created_at, rn) AS created_at, arg_max(updated_at, rn) AS updated_at,
      arg_max(description, rn) FILTER (description IS NOT NULL) AS description,
      bool_or(h1b_confirmed) AS h1b_confirmed, arg_min(ats_score, rn) AS ats_score,
      max(CASE WHEN rn = 1 THEN ats_grade END) AS ats_grade, arg_min(selected, rn) AS selected
    FROM r GROUP BY jd_url""")


_JOBS_SQL = _jobs_sql()


def _job_sides(v: Views):
    """Old listings with scores and grades of their own, and later ones with the scraped columns."""
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    jobs = v.jobs()
    old = first_per_key(jobs.where(F.col("created_at") < cut), ["jd_url"], ["created_at", "id"])
    old = old.withColumns({"ats_score": (F.col("id") % 100).cast("int"),
                           "ats_grade": F.when(F.col("id") % 3 == 0, F.lit("B"))})
    return old, jobs.select(*JOB_LIST).where(F.col("created_at") >= cut)


@query("upsert_jobs", _JOBS_SQL)
def _(v):
    old, delta = _job_sides(v)
    return G.merge_jobs(old, delta, ASOF, ["created_at", "id"])


@query("upsert_jobs_stored", _JOBS_SQL)
def _(v):
    old, delta = _job_sides(v)
    table = KeyedTable(v.spark, scratch_path(v.spark, "jobs"), "jd_url", buckets=8)
    table.create(old)
    table.write(G.merge_jobs_stored(table.read(), delta, ASOF, ["created_at", "id"], table.buckets), 1)
    return table.read()


@query("upsert_companies_stored", _companies_sql(
    "arg_max({0}, d * 1000000000000 + seq) FILTER ({0} IS NOT NULL)"))
def _(v):
    old, delta, _ = _company_sides(v)
    table = KeyedTable(v.spark, scratch_path(v.spark, "companies"), "name", buckets=8)
    table.create(old)
    table.write(G.merge_companies_stored(table.read(), delta, ASOF, ["seq"], table.buckets), 1)
    return table.read()


@query("insert_ignore", with_views("v_companies", then=f""", {_OLD_C} SELECT id, name, domain FROM b
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY d, seq) = 1"""))
def _(v):
    old, delta, _ = _company_sides(v)
    return G.insert_ignore(old.select("id", "name", "domain"),
                           delta.select("id", "name", "domain"), "name", ["id"])


@query("seed_companies", """SELECT s_name AS name, true AS h1b_confirmed, 'seed' AS h1b_source,
       CAST(100 AS BIGINT) AS lca_count, '' AS domain FROM supplier""")
def _(v):
    names = v.table("supplier").select(F.col("s_name").alias("name"))
    return G.seed_companies(names, "seed").drop("id", "created_at")


@query("unique_violations", with_views("v_jobs", then="""SELECT jd_url, count(*) AS n FROM v_jobs
       GROUP BY jd_url HAVING count(*) > 1"""))
def _(v):
    return G.unique_violations(v.jobs(), "jd_url")


# --- mutations ---

_DELTA = """d AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 1 THEN 'screening'
    WHEN quality = 1 THEN 'offer' ELSE 'rejected' END AS st FROM labels)"""


def _decisions(v: Views) -> DataFrame:
    """Every id of the labels once as screening, the even ones then with a decision."""
    rows = v.table("labels").select(F.col("doc_id").alias("id"), F.when(
        F.col("quality") == 1, F.lit("offer")).otherwise(F.lit("rejected")).alias("status"))
    first = rows.select("id", F.lit("screening").alias("status"), F.lit(0).alias("seq"))
    return first.unionByName(rows.where("id % 2 = 0").withColumn("seq", F.lit(1)))


@query("status_transition", with_views("v_jobs", then=f""", {_DELTA} SELECT j.id,
       coalesce(st, applied_status) AS applied_status,
       CASE WHEN st IS NULL THEN applied_at ELSE {TS} END AS applied_at,
       CASE WHEN st IS NULL THEN updated_at ELSE {TS} END AS updated_at
       FROM v_jobs j LEFT JOIN d ON d.id = j.id"""))
def _(v):
    return M.status_transition(v.jobs(), _decisions(v), ASOF, ["seq"]).select(
        "id", "applied_status", "applied_at", "updated_at")


@query("mark_sent", with_views("v_outreach", "v_contacts", "v_jobs", then=f""", due AS (SELECT DISTINCT id
       FROM ({_SENDABLE.format('')})) SELECT o.id, o.subject, o.body,
       CASE WHEN due.id IS NULL THEN status ELSE 'sent' END AS status,
       CASE WHEN due.id IS NULL THEN sent_at ELSE {TS} END AS sent_at
       FROM v_outreach o LEFT JOIN due ON due.id = o.id"""))
def _(v):
    due = O.sendable_drafts(v.outreach(), v.contacts(), v.jobs(), False).select("id")
    return M.mark_sent(v.outreach(), due, ASOF).select("id", "subject", "body", "status", "sent_at")


@query("reset_preview", with_views("v_jobs", "v_outreach", then="""SELECT 'job' AS kind, id,
       applied_status AS status FROM v_jobs WHERE applied_status IN ('applied', 'applying', 'failed')
       UNION ALL SELECT 'outreach', id, status FROM v_outreach WHERE status = 'sent'"""))
def _(v):
    return M.reset_preview(v.jobs(), v.outreach())


@query("reset_apply", with_views("v_jobs", then="""SELECT id, CASE WHEN applied_status IN
       ('applied', 'applying', 'failed') THEN 'pending' ELSE applied_status END AS applied_status,
       false AS selected FROM v_jobs"""))
def _(v):
    return M.reset_jobs(v.jobs()).select("id", "applied_status", "selected")


@query("reset_outreach", with_views("v_outreach", then="""SELECT id, body, sent_at, CASE status
       WHEN 'sent' THEN 'draft' ELSE status END AS status FROM v_outreach"""))
def _(v):
    return M.reset_outreach(v.outreach()).select("id", "body", "sent_at", "status")


@query("purge_bad", with_views("v_outreach", then=f"""SELECT id, outreach_type, body FROM v_outreach
       WHERE NOT (outreach_type = 'cold_email' AND coalesce({SQL_BAD}, false))"""))
def _(v):
    return M.purge_bad(v.outreach()).select("id", "outreach_type", "body")


@query("repair_subjects", with_views("v_outreach", then="""SELECT id, CASE WHEN subject LIKE '] %'
       THEN trim(ltrim(subject, '] ')) ELSE subject END AS subject FROM v_outreach"""))
def _(v):
    return M.repair_subjects(v.outreach()).select("id", "subject")


@query("plan_followups", with_views("v_jobs", then="""SELECT id AS job_id, id % 7 AS contact_id,
       'followup' AS outreach_type, '' AS subject, '' AS body, 'draft' AS status,
       unnest([3, 7, 14]) AS followup_day FROM v_jobs WHERE applied_status = 'applied'"""))
def _(v):
    applied = v.jobs().where(F.col("applied_status") == "applied").select(
        F.col("id").alias("job_id"), (F.col("id") % 7).alias("contact_id"))
    return O.plan_followups(applied)


_KEPT = "kept AS (SELECT id FROM v_jobs WHERE applied_status = 'pending')"


@query("fk_orphans", with_views("v_log", "v_jobs", then=f""", {_KEPT} SELECT id, job_id FROM v_log
       WHERE job_id NOT IN (SELECT id FROM kept)"""))
def _(v):
    kept = v.jobs().where(F.col("applied_status") == "pending")
    return M.fk_orphans(v.log(), kept, "job_id").select("id", "job_id")


@query("fk_cascade", with_views("v_outreach", "v_jobs", then=f""", {_KEPT} SELECT id, job_id, status
       FROM v_outreach WHERE job_id IN (SELECT id FROM kept)"""))
def _(v):
    kept = v.jobs().where(F.col("applied_status") == "pending")
    return M.fk_cascade(v.outreach(), kept, "job_id").select("id", "job_id", "status")


@query("fk_set_null", with_views("v_job_contacts", "v_jobs", then=f""", {_KEPT} SELECT c.id, k.id AS job_id,
       name FROM v_job_contacts c LEFT JOIN kept k ON k.id = c.job_id"""))
def _(v):
    kept = v.jobs().where(F.col("applied_status") == "pending")
    return M.fk_cascade(v.job_contacts(), kept, "job_id", action="set_null").select(
        "id", "job_id", "name")


# --- reports ---

_FUNNEL = """SELECT (SELECT count(*) FROM v_jobs) AS total_jobs,
    (SELECT count(*) FROM v_jobs WHERE h1b_confirmed) AS h1b_jobs,
    (SELECT count(*) FROM v_jobs WHERE applied_status = 'applied') AS applied,
    (SELECT count(*) FROM v_jobs WHERE applied_status = 'interview') AS interviews,
    (SELECT count(*) FROM v_outreach WHERE status = 'sent') AS emails_sent"""


@query("funnel_stats", with_views("v_jobs", "v_outreach", then=_FUNNEL))
def _(v):
    return A.funnel_stats(v.jobs(), v.outreach())


@query("stats_long", with_views("v_jobs", "v_outreach", then=f""", f AS ({_FUNNEL})
    SELECT 'Total Jobs Found' AS metric, total_jobs AS value FROM f UNION ALL
    SELECT 'H1B Confirmed', h1b_jobs FROM f UNION ALL SELECT 'Applied', applied FROM f UNION ALL
    SELECT 'Interviews', interviews FROM f UNION ALL SELECT 'Emails Sent', emails_sent FROM f"""))
def _(v):
    return K.stats_long(A.funnel_stats(v.jobs(), v.outreach()))


@query("dashboard_stats", with_views("v_jobs", "v_outreach", "v_contacts", then="""SELECT
    (SELECT count(*) FROM v_jobs) AS total, (SELECT count(*) FROM v_jobs WHERE h1b_confirmed) AS h1b,
    (SELECT count(*) FROM v_jobs WHERE applied_status = 'pending' AND h1b_confirmed) AS pending,
    (SELECT count(*) FROM v_jobs WHERE applied_status = 'applied') AS applied,
    (SELECT count(*) FROM v_outreach WHERE status = 'sent') AS emails,
    (SELECT count(*) FROM v_outreach WHERE status = 'draft') AS drafts,
    (SELECT count(*) FROM v_contacts) AS contacts"""))
def _(v):
    return A.dashboard_stats(v.jobs(), v.outreach(), v.contacts())


@query("status_counts", with_views("v_outreach", then="""SELECT status, count(*) AS n FROM v_outreach
       WHERE outreach_type = 'cold_email' GROUP BY status"""))
def _(v):
    return A.status_counts(v.outreach().where(F.col("outreach_type") == "cold_email"))


_DIGEST = """SELECT upper(event[1]) || replace(event[2:], '_seen', ' Seen') AS label, event,
    count(*) AS n, max(created_at) AS last_at FROM v_log
    WHERE CAST(created_at AS DATE) = DATE '2024-01-15' GROUP BY event"""


@query("daily_digest", with_views("v_log", then=_DIGEST))
def _(v):
    return A.daily_digest(v.log(), "2024-01-15")


@query("digest_text", with_views("v_jobs", "v_outreach", "v_log", then=f""", f AS ({_FUNNEL}),
    e AS ({_DIGEST}) SELECT 'Digest for Monday, January 15' || chr(10) || chr(10)
    || 'Listings ' || total_jobs || ', with sponsor ' || h1b_jobs || chr(10)
    || 'Applications ' || applied || ', interviews ' || interviews || chr(10)
    || 'Mails sent ' || emails_sent || chr(10) || chr(10)
    || 'Events of the day: ' || (SELECT sum(n) FROM e) || chr(10)
    || (SELECT string_agg('- ' || label || ' x ' || n, chr(10) ORDER BY last_at DESC, event) FROM e)
    AS text FROM f"""))
def _(v):
    return A.digest_text(A.funnel_stats(v.jobs(), v.outreach()),
                         A.daily_digest(v.log(), "2024-01-15"), "2024-01-15")


@query("match_rate", with_views("v_jobs", then="""SELECT count(*) AS total,
    count(*) FILTER (h1b_confirmed) AS h1b,
    count(*) FILTER (h1b_confirmed) * 100 / greatest(count(*), 1) AS pct FROM v_jobs"""))
def _(v):
    return A.match_rate(v.jobs())


@query("batch_summary", with_views("v_jobs", then="""SELECT count(*) FILTER (applied_status = 'applied')
    AS success, count(*) AS total FROM v_jobs WHERE applied_status IN ('applied', 'failed')"""))
def _(v):
    tried = v.jobs().where(F.col("applied_status").isin("applied", "failed"))
    return A.batch_summary(tried, F.col("applied_status") == "applied")


@query("quality_ratio", with_views("v_outreach", then=f"""SELECT count(*) FILTER ({SQL_BAD}) AS bad,
    count(*) AS total FROM v_outreach WHERE outreach_type = 'cold_email'"""))
def _(v):
    return A.quality_ratio(v.outreach())


# --- metadata and drafts ---

_SAFE = r"substr(regexp_replace(trim({0}), '[^\pL\pN_\-]', '_', 'g'), 1, 25)"
_META = f"""m AS (SELECT id AS job_id, company, role, applied_status,
    {_SAFE.format('company')} || '_' || {_SAFE.format('role')} || '_' || id AS folder,
    '2002-01-01T00:00:00' AS created_at FROM v_jobs)"""


@query("metadata_patch", with_views("v_jobs", then=f""", {_META}, {_DELTA} SELECT job_id, company, folder,
    created_at, coalesce(st, applied_status) AS applied_status,
    CASE WHEN st = 'offer' THEN 'board' END AS ats,
    CASE WHEN st IS NOT NULL THEN '2002-01-02T00:00:00' END AS updated_at,
    CASE WHEN st IS NOT NULL THEN 1 - d.id % 2 END AS round
    FROM m LEFT JOIN d ON d.id = m.job_id"""))
def _(v):
    delta = _decisions(v).select(
        F.col("id").alias("job_id"), F.col("status").alias("applied_status"), "seq",
        F.when(F.col("status") == "offer", F.lit("board")).alias("ats"),
        F.col("seq").alias("round"))
    out = K.metadata_patch(K.metadata_rows(v.jobs(), ASOF), delta, "2002-01-02 00:00:00", seq=["seq"])
    return out.select("job_id", "company", "folder", "created_at", "applied_status", "ats",
                      "updated_at", "round")


@query("metadata_patch_nulls", with_views("v_jobs", then=f""", {_META}, {_DELTA} SELECT job_id, folder,
    CASE WHEN st IS NULL THEN company WHEN st = 'offer' THEN st END AS company
    FROM m LEFT JOIN d ON d.id = m.job_id"""))
def _(v):
    delta = _decisions(v).select(F.col("id").alias("job_id"), "seq",
                                 F.when(F.col("status") == "offer", "offer").alias("company"))
    out = K.metadata_patch(K.metadata_rows(v.jobs(), ASOF), delta, ASOF, seq=["seq"], nulls=True)
    return out.select("job_id", "folder", "company")


@query("metadata_status_counts", with_views("v_jobs", then="""SELECT applied_status AS status,
       count(*) AS n FROM v_jobs GROUP BY 1"""))
def _(v):
    path = scratch_path(v.spark, "metadata")
    K.write_metadata(K.metadata_rows(v.jobs(), ASOF), path)
    return A.metadata_status_counts(read_metadata_lines(v.spark, path))


_FOLDERS = """m AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'pending' END AS status,
    page_id % 5 = 0 AS damaged FROM pages WHERE page_id % 7 <> 0)"""


FOLDER_TASKS = 96


def _metadata_folders(v: Views) -> str:
    """A folder per page with a metadata file: a fifth is cut short, a seventh of the folders has none."""
    key, path = F.col("page_id"), scratch_path(v.spark, "metadata-folders")
    status = F.when(key % 3 == 0, F.lit("applied")).when(key % 3 == 1, F.lit("pending"))
    text = F.to_json(F.struct(key.alias("job_id"), F.col("url").alias("jd_url"), status.alias("applied_status")))
    rows = v.pages().where(key % 7 != 0).select(
        F.concat(F.lit("folder_"), key.cast("string")).alias("folder"),
        F.when(key % 5 == 0, F.substring(text, 1, 12)).otherwise(text).alias("value"))
    K.write_folders(rows, path, FOLDER_TASKS)
    return path


@query("metadata_folders", f"""WITH {_FOLDERS} SELECT 'folder_' || page_id AS folder, damaged,
    CASE WHEN NOT damaged THEN page_id END AS job_id, CASE WHEN NOT damaged THEN status END AS status FROM m""")
def _(v):
    path = _metadata_folders(v)
    with listed_in_tasks(v.spark, FOLDER_TASKS):
        rows = scan_metadata(v.spark, path, "part-*.txt")
    good = ~F.col("damaged")
    return rows.select(F.regexp_extract("file", r"folder=(\w+)", 1).alias("folder"), "damaged",
                       F.when(good, F.col("job_id")).alias("job_id"), F.when(good, F.col("applied_status")).alias("status"))


@query("metadata_folders_stream", f"""WITH {_FOLDERS} SELECT coalesce(status, 'pending') AS status, count(*) AS n
    FROM m WHERE NOT damaged GROUP BY 1""")
def _(v):
    """The same files as a stream into a table, in batches of at most 100 files; then the status counts."""
    out, checkpoint = _dirs(v, "metadata-stream")
    path = _metadata_folders(v)
    with listed_in_tasks(v.spark, FOLDER_TASKS), listed_on_driver(v.spark, 100), small_files(v.spark):
        rows = stream_metadata(v.spark, path, "part-*.txt", 100)
        (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
    return A.metadata_status_counts(v.spark.read.schema(rows.schema).parquet(out).where(~F.col("damaged")))


@query("draft_documents", with_views("v_outreach", "v_contacts", then=""", d AS (SELECT o.*, c.id AS cid,
    c.name, c.email, c.title, CASE WHEN outreach_type = 'cold_email'
      THEN 'cold_email_' || coalesce(contact_type, 'None') || '.txt'
      ELSE 'followup_day' || followup_day || '.txt' END AS file_name
    FROM v_outreach o LEFT JOIN v_contacts c ON c.id = o.contact_id)
    SELECT job_id, file_name, 'TO: ' || coalesce(email, 'None') || chr(10) || 'CONTACT: '
      || coalesce(name, 'None') || ' (' || coalesce(title, 'None') || ')' || chr(10) || 'SUBJECT: '
      || coalesce(subject, 'None') || chr(10) || 'STATUS: ' || status || chr(10) || repeat('=', 60)
      || chr(10) || chr(10) || coalesce(body, 'None') AS content FROM d
    QUALIFY row_number() OVER (PARTITION BY job_id, file_name ORDER BY id DESC, contact_id DESC
      NULLS LAST, status DESC, subject DESC NULLS LAST, body DESC NULLS LAST) = 1"""))
def _(v):
    return K.draft_documents(v.outreach(), v.contacts())


@query("snapshot_documents", with_views("v_jobs", then="""SELECT id AS job_id, 'jd_snapshot.txt' AS
       file_name, description AS content FROM v_jobs WHERE coalesce(description, '') <> ''"""))
def _(v):
    return K.snapshot_documents(v.jobs())


# --- what is written and read again ---

@query("snapshot_round_trip", with_views("v_jobs", then="""SELECT id AS job_id, 'jd_snapshot.txt' AS
       file_name, description AS content FROM v_jobs WHERE coalesce(description, '') <> ''"""))
def _(v):
    path = scratch_path(v.spark, "snapshots")
    K.write_documents(K.snapshot_documents(v.jobs()), path)
    return v.spark.read.schema("job_id bigint, file_name string, content string").json(path)


@query("export_round_trip", with_views("v_jobs", then="""SELECT id, company, applied_status AS status,
       coalesce(strftime(applied_at, '%Y-%m-%d %H:%M:%S'), '') AS applied_at FROM v_jobs"""))
def _(v):
    path = scratch_path(v.spark, "export")
    K.write_export(K.export_jobs(v.jobs()), path)
    rows = v.spark.read.option("header", True).csv(path)
    return rows.select(F.col("id").cast("bigint").alias("id"), "company", "status",
                       F.coalesce("applied_at", F.lit("")).alias("applied_at"))


@query("version_round_trip", with_views("v_contacts", then="""SELECT id, company, name, title, email,
       contact_type FROM v_contacts"""))
def _(v):
    base = scratch_path(v.spark, "versions")
    write_version(v.contacts(), base, "contacts", "v1")
    return read_table(v.spark, base, "contacts", "v1").select(
        "id", "company", "name", "title", "email", "contact_type")


@query("profile_files", "SELECT text || chr(10) AS profile FROM benchmark")
def _(v):
    path = scratch_path(v.spark, "profiles")
    v.table("benchmark").write.partitionBy("item_id").text(path)
    default = v.table("benchmark").limit(1).select(F.lit("none").alias("profile"))
    return load_profile(v.spark, path, default)


# --- rendered text ---

def sql_template(template: str, slots: dict[str, str], limits: dict[str, int] | None = None) -> str:
    import re
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            if piece:
                parts.append("'" + piece.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        else:
            expr = f"coalesce({slots[piece]}, '')"
            n = (limits or {}).get(piece)
            parts.append(f"substr({expr}, 1, {n})" if n else expr)
    return " || ".join(parts)


_SLOTS = {"company": "company", "role": "role", "sender": q(SENDER)}


@query("render_followups", with_views("v_outreach", "v_jobs", "v_contacts", then=f"""SELECT o.id, o.job_id,
    o.contact_id, c.email AS to_email, {sql_template(FOLLOWUP_SUBJECT, {**_SLOTS, 'company': 'j.company',
    'role': 'j.role'})} AS subject, {sql_template(FOLLOWUP_BODIES[7], {**_SLOTS, 'company': 'j.company',
    'role': 'j.role'})} AS body FROM {_WITH_C} JOIN v_jobs j ON j.id = o.job_id
    WHERE o.outreach_type = 'followup' AND o.status = 'draft' AND o.followup_day = 7
    AND coalesce(c.email, '') <> ''"""))
def _(v):
    return O.followups_resolved(v.outreach(), v.jobs(), v.contacts(), 7, SENDER)


def _followup_sql(day: int, body: int | None) -> str:
    slots = {**_SLOTS, "company": "j.company", "role": "j.role"}
    return f"""SELECT o.id, o.job_id, o.contact_id, c.email AS to_email, {sql_template(FOLLOWUP_SUBJECT, slots)} AS subject,
        {sql_template(FOLLOWUP_BODIES[body], slots)} AS body FROM {_WITH_C} JOIN v_jobs j ON j.id = o.job_id
        WHERE o.outreach_type = 'followup' AND o.status = 'draft' AND o.followup_day = {day} AND coalesce(c.email, '') <> ''"""


@query("render_followups_first_and_last", with_views("v_outreach", "v_jobs", "v_contacts",
       then=_followup_sql(3, 3) + " UNION ALL " + _followup_sql(14, None)))
def _(v):
    first, last = (O.followups_resolved(v.outreach(), v.jobs(), v.contacts(), day, SENDER) for day in (3, 14))
    return first.unionByName(last)


_PROMPT_SLOTS = {
    **_SLOTS, "title": "title", "profile": "profile",
    "first_name": "CASE WHEN coalesce(name, '') IN ('', 'Hiring Team') THEN 'there' "
                  "ELSE split_part(name, ' ', 1) END",
    "description": "CASE WHEN coalesce(description, '') = '' THEN 'Role: ' || role || ' at ' "
                   "|| company ELSE description END"}


def sql_email_prompt(number: str) -> str:
    texts = [sql_template(PROMPTS[k].text, _PROMPT_SLOTS, PROMPTS[k].limits)
             for k in ("email_1", "email_2", "email_3")]
    return f"CASE {number} WHEN 1 THEN {texts[0]} WHEN 2 THEN {texts[1]} ELSE {texts[2]} END"


_KEYED = f"""jk AS (SELECT id AS jid, company, role, description, CASE
    {sql_first_match('trim(lower(role))', vocab.ROLE_VARIANTS, 'data')}
    WHEN 'data' THEN 0 WHEN 'analyst' THEN 1 WHEN 'sql' THEN 2 ELSE 3 END AS variant FROM v_jobs
    WHERE applied_status = 'pending' AND h1b_confirmed),
    jp AS (SELECT jk.*, p.text AS profile FROM jk LEFT JOIN v_profiles p USING (variant))"""


def _keyed_jobs(v: Views) -> DataFrame:
    from leadloom.operators.filters import pending_jobs
    names = F.array(*[F.lit(n) for n in ("data", "analyst", "sql", "sde")])
    variant = (F.array_position(names, classify_role("role")) - 1).cast("bigint")
    return pending_jobs(v.jobs()).select("id", "company", "role", "description",
                                         variant.alias("variant"))


@query("render_prompts", with_views("v_jobs", "v_job_contacts", "v_profiles", then=f""", {_KEYED}
    SELECT jid AS job_id, c.id AS contact_id, jid % 3 + 1 AS template,
      {sql_email_prompt('jid % 3 + 1')} AS prompt FROM jp JOIN v_job_contacts c ON c.job_id = jid
    WHERE email <> '' AND contact_type IN ('hr', 'hiring_manager', 'team_lead')"""))
def _(v):
    from leadloom.operators.filters import actionable_contacts
    return O.prompt_table(_keyed_jobs(v), actionable_contacts(v.job_contacts()), v.profiles(), SENDER)


@query("listing_prompts", with_views("v_jobs", "v_profiles", then=f""", {_KEYED}
    SELECT jid AS id, 'bullets' AS kind,
      {sql_template(PROMPTS['bullets'].text, _PROMPT_SLOTS)} AS prompt FROM jp UNION ALL
    SELECT jid, 'letter', {sql_template(PROMPTS['letter'].text, _PROMPT_SLOTS, PROMPTS['letter'].limits)}
    FROM jp"""))
def _(v):
    return O.listing_prompts(_keyed_jobs(v), v.profiles(), SENDER)


@query("referral_prompts", with_views("v_job_contacts", "v_profiles", then=f""", r AS (SELECT job_id AS k,
    c.id, 'Firm ' || job_id AS company, 'Engineer' AS role, name, title, p.text AS profile
    FROM v_job_contacts c LEFT JOIN v_profiles p ON p.variant = c.pos
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY c.id, name) <= 3)
    SELECT company, id, {sql_template(PROMPTS['referral'].text, {**_SLOTS, 'name': 'name',
    'title': 'title', 'profile': 'profile'}, PROMPTS['referral'].limits)} AS prompt FROM r"""))
def _(v):
    people = v.job_contacts().select(
        "id", F.concat(F.lit("Firm "), F.col("job_id").cast("string")).alias("company"),
        F.lit("Engineer").alias("role"), "name", "title", F.col("pos").cast("bigint").alias("variant"))
    return O.referral_prompts(people, v.profiles(), SENDER)


# --- streams ---

class StreamViews(Views):
    """The same views with every base table read as a file stream."""

    def table(self, name: str) -> DataFrame:
        path = f"{self.base}/{name}.parquet"
        # a stream needs a folder or a glob, and a test table may be one file
        return S.file_stream(self.spark, path + "*", self.spark.read.parquet(path).schema)


def _dirs(v: Views, name: str) -> tuple[str, str]:
    return scratch_path(v.spark, name), scratch_path(v.spark, f"{name}-checkpoint")


@query("stream_digest", with_views("v_log", then="""SELECT CAST(created_at AS DATE) AS day,
    upper(event[1]) || replace(event[2:], '_seen', ' Seen') AS label, event, count(*) AS n
    FROM v_log WHERE date_trunc('day', created_at) + INTERVAL 1 DAY <=
      (SELECT max(created_at) - INTERVAL 1 HOUR FROM v_log) GROUP BY 1, 2, 3"""))
def _(v):
    out, checkpoint = _dirs(v, "digest")
    log = StreamViews(v.spark, v.base).log().withColumn("created_at", S.as_utc_instant("created_at"))
    digest = S.stream_digest(log, "1 hour")
    S.run_digest(digest, out, checkpoint).awaitTermination()
    return v.spark.read.schema(digest.schema).parquet(out)


@query("stream_ingest", _JOBS_SQL)
def _(v):
    log_dir, checkpoint = _dirs(v, "ingest")
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    arriving = StreamViews(v.spark, v.base).jobs().select(*JOB_LIST).where(F.col("created_at") >= cut)
    S.stream_ingest(arriving, log_dir, checkpoint, ASOF).awaitTermination()
    old, _ = _job_sides(v)
    return S.ingested_jobs(old, log_dir, ASOF, ["created_at", "id"])


@query("release_followups", with_views("v_outreach", "v_jobs", "v_contacts", then=f"""SELECT o.id,
    arg_min(o.job_id, c.email) AS job_id, min(c.email) AS to_email FROM {_WITH_C}
    JOIN v_jobs j ON j.id = o.job_id WHERE o.outreach_type = 'followup' AND o.status = 'draft'
    AND o.followup_day = 7 AND coalesce(c.email, '') <> '' GROUP BY o.id"""))
def _(v):
    ledger, checkpoint = _dirs(v, "ledger")
    drafts = StreamViews(v.spark, v.base).outreach()
    S.release_followups(drafts, v.jobs(), v.contacts(), 7, ledger, checkpoint,
                        ASOF).awaitTermination()
    return S.read_ledger(v.spark, ledger).select("id", "job_id", "to_email")


_WAVES = ("1998-01-01", "1999-06-01", "2000-06-01", "9999-01-01")


@query("ingest_store", _jobs_sql(
    flag="EXISTS (SELECT 1 FROM s WHERE contains(n, s.m) OR contains(s.m, n))",
    group=f"CASE WHEN created_at < TIMESTAMP '{_WAVES[1]}' THEN 1 ELSE 2 END",
    more=f""", s AS (SELECT trim({sql_removed("lower('Customer ' || c_custkey || ' LLC')", vocab.COMPANY_REMOVALS)}) AS m
        FROM customer WHERE c_acctbal > 9000)""").replace("FROM v_jobs WHERE created_at >=", f"""FROM (SELECT *, trim({
            sql_removed('lower(company)', vocab.COMPANY_REMOVALS)}) AS n FROM v_jobs) WHERE created_at >="""))
def _(v):
    """Three waves in three batches; the first is merged before the others come, these two in one refresh."""
    old, delta = _job_sides(v)
    sponsors = v.table("customer").where("c_acctbal > 9000").select(
        F.concat(F.lit("Customer "), F.col("c_custkey").cast("string"), F.lit(" LLC")).alias("name"))
    store = ListingStore(v.spark, scratch_path(v.spark, "listings"), buckets=8)
    store.create(old)
    arrived = scratch_path(v.spark, "arrivals")
    for n, (low, high) in enumerate(zip(_WAVES, _WAVES[1:])):
        part = (F.col("created_at") >= F.lit(low).cast("timestamp_ntz")) & (
            F.col("created_at") < F.lit(high).cast("timestamp_ntz"))
        delta.where(part).write.mode("append").parquet(arrived)
        stream = S.file_stream(v.spark, arrived, delta.schema)
        store.ingest(stream, sponsors, ["created_at", "id"], ["id"]).awaitTermination()
        if n != 1:
            store.refresh(ASOF)
    return store.table.read()


@query("release_ledger", with_views("v_outreach", "v_jobs", "v_contacts", then=f"""SELECT o.id, o.followup_day,
    arg_min(o.job_id, c.email) AS job_id, min(c.email) AS to_email FROM {_WITH_C}
    JOIN v_jobs j ON j.id = o.job_id WHERE o.outreach_type = 'followup' AND o.status = 'draft'
    AND o.followup_day IN (3, 7) AND coalesce(c.email, '') <> '' GROUP BY o.id, o.followup_day"""))
def _(v):
    """Two days, the second released twice with a compaction between: every draft is there once for each day."""
    base, checkpoint = _dirs(v, "ledger")
    ledger = ReleaseLedger(v.spark, base, buckets=4)
    for n, day in enumerate((3, 7, 7)):
        drafts = StreamViews(v.spark, v.base).outreach()
        ledger.release(drafts, v.jobs(), v.contacts(), day, f"{checkpoint}-{n}", ASOF).awaitTermination()
        ledger.compact(least=1 + n)
    rows = ledger.rows().groupBy("id", "followup_day").agg(F.min(F.struct("job_id", "to_email")).alias("_r"))
    return rows.select("id", "followup_day", "_r.job_id", "_r.to_email")


# --- counts from deltas, deletion through several tables, change feeds, events by day ---

_DUE_IDS = f"due AS (SELECT DISTINCT id FROM ({_SENDABLE.format('')}))"
_MUTATED = f""", {_DELTA}, {_DUE_IDS},
    j AS (SELECT v_jobs.* REPLACE (coalesce(st, applied_status) AS applied_status) FROM v_jobs LEFT JOIN d ON d.id = v_jobs.id),
    o AS (SELECT v_outreach.* REPLACE (CASE WHEN due.id IS NULL THEN status ELSE 'sent' END AS status)
      FROM v_outreach LEFT JOIN due ON due.id = v_outreach.id)"""


@query("dashboard_maintained", with_views("v_jobs", "v_outreach", "v_contacts", then=_MUTATED + f""",
    p AS (SELECT * FROM o WHERE NOT (outreach_type = 'cold_email' AND coalesce({SQL_BAD}, false)))
    SELECT (SELECT count(*) FROM j) AS total, (SELECT count(*) FROM j WHERE h1b_confirmed) AS h1b,
    (SELECT count(*) FROM j WHERE applied_status = 'pending' AND h1b_confirmed) AS pending,
    (SELECT count(*) FROM j WHERE applied_status = 'applied') AS applied,
    (SELECT count(*) FROM p WHERE status = 'sent') AS emails,
    (SELECT count(*) FROM p WHERE status = 'draft') AS drafts, (SELECT count(*) FROM v_contacts) AS contacts"""))
def _(v):
    """Status changes, sent marks and a purge, each counted from its own rows; the oracle recounts everything."""
    jobs, mails, contacts = v.jobs(), v.outreach(), v.contacts()
    counts = D.MaintainedCounts(v.spark, scratch_path(v.spark, "counts"), D.dashboard_metrics())
    counts.start({"jobs": jobs, "outreach": mails, "contacts": contacts})
    decisions = _decisions(v)
    before = D.touched(jobs, decisions)
    counts.apply(1, "jobs", before, M.status_transition(before, decisions, ASOF, ["seq"]))
    due = O.sendable_drafts(mails, contacts, jobs, False).select("id")
    before = D.touched(mails, due)
    counts.apply(2, "outreach", before, M.mark_sent(before, due, ASOF))
    before = P.bad_bodies(M.mark_sent(mails, due, ASOF))
    counts.apply(3, "outreach", before, M.purge_bad(before))
    return counts.current()


@query("status_counts_maintained", with_views("v_jobs", then=f""", {_DELTA} SELECT coalesce(st, applied_status)
    AS applied_status, count(*) AS n FROM v_jobs LEFT JOIN d ON d.id = v_jobs.id GROUP BY 1"""))
def _(v):
    jobs, decisions, key = v.jobs(), _decisions(v), ["applied_status"]
    before = D.touched(jobs, decisions)
    moved = D.signed_groups(before, M.status_transition(before, decisions, ASOF, ["seq"]), key)
    return D.add_groups(A.status_counts(jobs, "applied_status"), moved, key)


_GONE = "g AS (SELECT id FROM v_jobs WHERE applied_status = 'failed')"


def _cascaded(v: Views, keys=M.FOREIGN_KEYS) -> dict[str, DataFrame]:
    """All tables after the failed listings went; a contact of this view belongs to the outreach with its id."""
    tables = {"jobs": v.jobs(), "contacts": v.job_contacts(), "tailored_docs": v.docs().withColumn("id", F.col("version")),
              "outreach": v.outreach().withColumn("contact_id", F.col("id"))}
    return M.delete_cascade(tables, "jobs", v.jobs().where(F.col("applied_status") == "failed"), keys)


@query("delete_cascade", with_views("v_jobs", "v_job_contacts", "v_docs", "v_outreach", then=f""", {_GONE}
    SELECT 'jobs' AS kind, id AS key, NULL::BIGINT AS job FROM v_jobs WHERE id NOT IN (SELECT id FROM g) UNION ALL
    SELECT 'contacts', c.id, CASE WHEN g.id IS NULL THEN job_id END FROM v_job_contacts c LEFT JOIN g ON g.id = job_id UNION ALL
    SELECT 'docs', version, job_id FROM v_docs WHERE job_id NOT IN (SELECT id FROM g) UNION ALL
    SELECT 'outreach', id, job_id FROM v_outreach WHERE job_id NOT IN (SELECT id FROM g)"""))
def _(v):
    t = _cascaded(v)
    kinds = {"jobs": F.lit(None).cast("bigint"), "contacts": F.col("job_id"), "docs": F.col("job_id"),
             "outreach": F.col("job_id")}
    parts = [t["tailored_docs" if k == "docs" else k].select(F.lit(k).alias("kind"), F.col("id").alias("key"), j.alias("job"))
             for k, j in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("delete_cascade_two_levels", with_views("v_jobs", "v_job_contacts", "v_outreach", then=f""", {_GONE},
    c AS (SELECT id FROM v_job_contacts WHERE job_id IN (SELECT id FROM g))
    SELECT 'contacts' AS kind, id AS key FROM v_job_contacts WHERE id NOT IN (SELECT id FROM c) UNION ALL
    SELECT 'outreach', id FROM v_outreach WHERE id NOT IN (SELECT id FROM c)"""))
def _(v):
    """Outreach hangs on contacts only, and contacts cascade: the deletion reaches it through them."""
    t = _cascaded(v, (M.ForeignKey("contacts", "job_id", "jobs", "cascade"),
                      M.ForeignKey("outreach", "contact_id", "contacts", "cascade")))
    return t["contacts"].select(F.lit("contacts").alias("kind"), F.col("id").alias("key")).unionByName(
        t["outreach"].select(F.lit("outreach").alias("kind"), F.col("id").alias("key")))


_V2 = """n AS (SELECT * REPLACE (CASE WHEN id % 5 = 1 THEN 'seen' ELSE applied_status END AS applied_status,
    CASE WHEN id % 7 = 0 THEN NULL ELSE description END AS description) FROM v_jobs WHERE id % 11 <> 3
    UNION ALL SELECT * REPLACE (-id AS id) FROM v_jobs WHERE id % 13 = 2)"""


def _second_version(v: Views) -> DataFrame:
    jobs, key = v.jobs(), F.col("id")
    changed = jobs.where(key % 11 != 3).withColumns({
        "applied_status": F.when(key % 5 == 1, F.lit("seen")).otherwise(F.col("applied_status")),
        "description": F.when(key % 7 != 0, F.col("description"))})
    return changed.unionByName(jobs.where(key % 13 == 2).withColumn("id", -key))


def _stored_versions(v: Views) -> KeyedTable:
    table = KeyedTable(v.spark, scratch_path(v.spark, "versions"), "id", buckets=8)
    table.create(v.jobs())
    table.write(_second_version(v).repartition(table.buckets, "id"), 1)
    return table


@query("change_feed", with_views("v_jobs", then=f""", {_V2} SELECT CASE WHEN n.id IS NULL THEN 'delete'
    WHEN o.id IS NULL THEN 'insert' ELSE 'update' END AS change, coalesce(n.id, o.id) AS id, n.applied_status, n.description
    FROM v_jobs o FULL JOIN n ON n.id = o.id WHERE o.id IS NULL OR n.id IS NULL
    OR o.applied_status IS DISTINCT FROM n.applied_status OR o.description IS DISTINCT FROM n.description"""))
def _(v):
    table = _stored_versions(v)
    return change_feed(table.read(0), table.read(1), "id").select("change", "id", "applied_status", "description")


@query("change_feed_applied", with_views("v_jobs", then=f", {_V2} SELECT * FROM n"))
def _(v):
    table = _stored_versions(v)
    return apply_feed(table.read(0), change_feed(table.read(0), table.read(1), "id"), "id")


@query("events_last_day", with_views("v_log", then="""SELECT * FROM v_log WHERE CAST(created_at AS DATE) =
    (SELECT max(CAST(created_at AS DATE)) FROM v_log)"""))
def _(v):
    log = v.log()
    path = write_by_day(log, scratch_path(v.spark, "log-by-day"))
    return P.last_day(read_by_day(v.spark, path, log.schema)).drop("day")


@query("fresh_events_stored", with_views("v_log", then="""SELECT id, event, created_at FROM v_log
    WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 31 HOUR"""))
def _(v):
    log = v.log()
    path = write_by_day(log, scratch_path(v.spark, "log-by-day"))
    rows = P.fresh_stored(read_by_day(v.spark, path, log.schema), 31, "2024-01-30 00:00:00")
    return rows.select("id", "event", "created_at")
