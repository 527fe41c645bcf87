"""Filters, scalar functions, rankings and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import classify as C
from leadloom.functions import text as X
from leadloom.functions.scoring import keyword_gap, keyword_match
from leadloom.functions.sqlfuncs import register_sql_functions
from leadloom.operators import filters as P
from leadloom.operators import ranking as R
from leadloom.plans.registry import query
from leadloom.plans.views import q, sql_first_match, sql_list, with_views
from leadloom.sources import sinks as K
from leadloom.sources.tables import migrate_schema, select_by_ids, union_sources
from leadloom import schemas

JOB_COLS = ("id, company, role, jd_url, source, location, description, h1b_confirmed, "
            "applied_status, applied_at, created_at, updated_at")
JOB_LIST = JOB_COLS.split(", ")


# --- lookups and filters ---

@query("job_by_id", with_views("v_jobs", then=f"SELECT {JOB_COLS} FROM v_jobs WHERE id = 42"))
def _(v):
    return P.job_by_id(v.jobs(), 42).select(*JOB_LIST)


@query("pending_jobs", with_views("v_jobs", then=f"""SELECT {JOB_COLS} FROM v_jobs
       WHERE applied_status = 'pending' AND h1b_confirmed"""))
def _(v):
    return P.pending_jobs(v.jobs()).select(*JOB_LIST)


@query("contacts_for_job", with_views(
    "v_job_contacts", then="SELECT * FROM v_job_contacts WHERE job_id = 42"))
def _(v):
    return P.contacts_for_job(v.job_contacts(), 42)


@query("select_by_ids", with_views(
    "v_jobs", then="SELECT id, company, role FROM v_jobs WHERE id IN (1, 2, 3)"))
def _(v):
    return select_by_ids(v.jobs(), "1, 2,,3").select("id", "company", "role")


@query("status_in", with_views("v_jobs", then="""SELECT id, company, role, applied_status
       FROM v_jobs WHERE applied_status IN ('applied', 'applying', 'failed')"""))
def _(v):
    return P.status_in(v.jobs()).select("id", "company", "role", "applied_status")


@query("events_on_day", with_views(
    "v_log", then="SELECT * FROM v_log WHERE CAST(created_at AS DATE) = DATE '2024-01-15'"))
def _(v):
    return P.events_on_day(v.log(), "2024-01-15")


@query("fresh_events", with_views("v_log", then=f"""SELECT id, event, created_at,
       4 AS whole_days FROM v_log
       WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 96 HOUR"""))
def _(v):
    rows = P.fresh(v.log(), "created_at", 96, "2024-01-30 00:00:00")
    return rows.select("id", "event", "created_at", F.lit(P.whole_days(96)).alias("whole_days"))


@query("level_filter", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size IN (3, 4)")
def _(v):
    return P.level_filter(v.table("part"), "p_size").select("p_partkey", "p_name", "p_size")


@query("bad_subjects", with_views(
    "v_outreach", then="SELECT id, subject FROM v_outreach WHERE subject LIKE '] %'"))
def _(v):
    return P.bad_subjects(v.outreach()).select("id", "subject")


SQL_BAD = ("(coalesce(body, '') = '' OR "
           + " OR ".join(f"contains(lower(body), {q(m.lower())})" for m in vocab.DRAFT_MARKERS) + ")")


@query("bad_bodies", with_views("v_outreach", then=f"""SELECT id, job_id, body FROM v_outreach
       WHERE outreach_type = 'cold_email' AND {SQL_BAD}"""))
def _(v):
    return P.bad_bodies(v.outreach()).select("id", "job_id", "body")


@query("good_samples", with_views("v_outreach", then="""SELECT id, job_id, body FROM v_outreach
       WHERE outreach_type = 'cold_email' AND status = 'sent' AND coalesce(body, '') <> ''
         AND NOT contains(body, 'e.g.,') AND NOT contains(lower(body), '[company]')"""))
def _(v):
    return P.good_samples(v.outreach()).select("id", "job_id", "body")


@query("preview_text", "SELECT doc_id, substr(text, 1, 600) AS preview FROM documents")
def _(v):
    return v.table("documents").select("doc_id", X.preview("text", 600).alias("preview"))


@query("default_text", with_views("v_jobs", then="""SELECT id, CASE WHEN coalesce(description, '')
       = '' THEN 'Role: ' || role || ' at ' || company ELSE description END AS text FROM v_jobs"""))
def _(v):
    return v.jobs().select("id", X.default_text("description", "role", "company").alias("text"))


@query("actionable_contacts", with_views("v_contacts", then="""SELECT id, name, email, contact_type
       FROM v_contacts WHERE coalesce(email, '') <> ''
       AND contact_type IN ('hr', 'hiring_manager', 'team_lead')"""))
def _(v):
    return P.actionable_contacts(v.contacts()).select("id", "name", "email", "contact_type")


# --- scalar functions ---

def sql_removed(expr: str, parts) -> str:
    for part in parts:
        expr = f"replace({expr}, {q(part)}, '')"
    return expr


_NAMES = """(SELECT DISTINCT name FROM (SELECT name FROM v_companies
    UNION ALL SELECT s_name || ' Corporation' FROM supplier
    UNION ALL SELECT c_name || ' Co., Ltd.' FROM customer))"""
_NORM_SQL = with_views("v_companies", then=f"""SELECT name,
    trim({sql_removed('lower(name)', vocab.COMPANY_REMOVALS)}) AS company,
    trim({sql_removed('lower(name)', vocab.SPONSOR_REMOVALS)}) AS sponsor,
    {sql_removed('lower(name)', vocab.DOMAIN_REMOVALS)} || '.com' AS domain FROM {_NAMES}""")


def _names(v):
    return union_sources(
        v.companies().select("name"),
        v.table("supplier").select(F.concat("s_name", F.lit(" Corporation")).alias("name")),
        v.table("customer").select(F.concat("c_name", F.lit(" Co., Ltd.")).alias("name"))).distinct()


@query("norm_company", _NORM_SQL)
def _(v):
    return _names(v).select(
        "name", X.norm_company("name").alias("company"),
        X.norm_company("name", vocab.SPONSOR_REMOVALS).alias("sponsor"),
        X.domain_guess("name").alias("domain"))


@query("sql_functions", _NORM_SQL)
def _(v):
    register_sql_functions(v.spark)
    _names(v).createOrReplaceTempView("leadloom_names")
    return v.spark.sql("SELECT name, norm_company(name) AS company, norm_sponsor(name) AS sponsor, "
                       "domain_guess(name) AS domain FROM leadloom_names")


@query("url_host", r"""SELECT page_id, replace(lower(split_part(regexp_extract(
       url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), ':', 1)), 'www.', '') AS host,
       replace(lower(split_part(regexp_extract('https://' || split_part(url, '://', 2),
       '^https://([^/?#]*)', 1), ':', 1)), 'www.', '') AS bare_host FROM pages""")
def _(v):
    return v.table("pages").select(
        "page_id", X.url_host("url").alias("host"),
        X.url_host(F.substring_index("url", "://", -1)).alias("bare_host"))


@query("sql_urls", r"""SELECT page_id, replace(lower(split_part(regexp_extract(
       url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), ':', 1)), 'www.', '') AS host,
       'https://listings.example.com' || regexp_extract(url, '^https?://[^/]*(/.*)$', 1) AS absolute,
       url AS unchanged FROM pages""")
def _(v):
    register_sql_functions(v.spark)
    return v.spark.sql(r"""SELECT page_id, url_host(url) AS host,
        url_join('https://listings.example.com', regexp_extract(url, '^https?://[^/]*(/.*)$', 1)) AS absolute,
        url_join('https://listings.example.com', url) AS unchanged FROM {pages}""", pages=v.pages())


@query("sql_labels_and_files", with_views("v_outreach", "v_contacts", then=r"""SELECT o.id, CASE WHEN outreach_type =
       'cold_email' THEN 'cold_email_' || coalesce(contact_type, 'None') || '.txt'
       ELSE 'followup_day' || followup_day || '.txt' END AS file_name, strftime(o.created_at, '%A, %B %d') AS day_label,
       substr(coalesce(CAST(sent_at AS VARCHAR), CAST(o.created_at AS VARCHAR), ''), 1, 10) AS first_date,
       CASE outreach_type WHEN 'cold_email' THEN 'Cold Email' ELSE 'Followup' END AS label,
       substr(regexp_replace(trim(coalesce(subject, '')), '[^\pL\pN_\-]', '_', 'g'), 1, 25) AS safe
       FROM v_outreach o LEFT JOIN v_contacts c ON c.id = o.contact_id"""))
def _(v):
    register_sql_functions(v.spark)
    return v.spark.sql("""SELECT o.id, draft_file_name(outreach_type, followup_day, contact_type, o.id) AS file_name,
        date_label(created_at) AS day_label, first_date(CAST(sent_at AS STRING), CAST(created_at AS STRING)) AS first_date,
        title_label(outreach_type) AS label, safe_name(coalesce(subject, '')) AS safe
        FROM {o} o LEFT JOIN {c} c ON c.id = o.contact_id""", o=v.outreach(), c=v.contacts())


@query("url_canonical", "SELECT page_id, split_part(url, '?', 1) AS url FROM pages")
def _(v):
    return v.table("pages").select("page_id", X.url_canonical("url").alias("url"))


@query("url_join", r"""SELECT page_id, 'https://listings.example.com' ||
       regexp_extract(url, '^https?://[^/]*(/.*)$', 1) AS absolute, url AS unchanged,
       'https://listings.example.com/view?jk=' || page_id AS view_url FROM pages""")
def _(v):
    path = F.regexp_extract("url", r"^https?://[^/]*(/.*)$", 1)
    base = "https://listings.example.com"
    return v.table("pages").select(
        "page_id", X.url_join(base, path).alias("absolute"), X.url_join(base, "url").alias("unchanged"),
        X.view_url(base + "/view?jk=", F.col("page_id").cast("string")).alias("view_url"))


@query("digits_to_int", """SELECT c_custkey, coalesce(TRY_CAST(regexp_replace(c_name, '[^0-9]', '', 'g')
       AS BIGINT), 0) AS n, coalesce(TRY_CAST(regexp_replace(c_mktsegment, '[^0-9]', '', 'g')
       AS BIGINT), 0) AS none FROM customer""")
def _(v):
    return v.table("customer").select(
        "c_custkey", X.digits_to_int("c_name").alias("n"), X.digits_to_int("c_mktsegment").alias("none"))


@query("norm_text", "SELECT doc_id, translate(lower(text), '-_', '  ') AS norm FROM documents")
def _(v):
    return v.table("documents").select("doc_id", X.norm_text("text").alias("norm"))


SQL_NORM = "translate(lower(text), '-_', '  ')"


def sql_hits(expr: str, words) -> str:
    return f"list_filter({sql_list(words)}, lambda k: contains({expr}, k))"


@query("keyword_match", f"""SELECT doc_id, len(m) AS n_matched, array_to_string(m, ', ') AS matched,
       {len(vocab.HARD_SKILLS)} - len(m) AS n_missing FROM (SELECT doc_id,
       {sql_hits('t', vocab.HARD_SKILLS)} AS m FROM (SELECT doc_id, {SQL_NORM} AS t FROM documents))""")
def _(v):
    norm = v.documents().select("doc_id", X.norm_text("text").alias("t"))
    found = norm.select("doc_id", keyword_match("t", vocab.HARD_SKILLS).alias("m"))
    return found.select("doc_id", F.size("m").alias("n_matched"),
                        F.array_join("m", ", ").alias("matched"),
                        F.size(keyword_gap("m", vocab.HARD_SKILLS)).alias("n_missing"))


WORDS = ("the", "tion", "ing", "and", "ment", "eau", "ich", "sch", "ción", "über")


@query("keyword_gap", f"""SELECT doc_id, array_to_string({sql_hits('t', WORDS)}, ', ') AS matched,
       array_to_string(list_filter({sql_list(WORDS)}, lambda k: NOT contains(t, k)), ', ') AS missing
       FROM (SELECT doc_id, {SQL_NORM} AS t FROM documents)""")
def _(v):
    norm = v.documents().select("doc_id", X.norm_text("text").alias("t"))
    found = norm.select("doc_id", keyword_match("t", WORDS).alias("m"))
    return found.select("doc_id", F.array_join("m", ", ").alias("matched"),
                        F.array_join(keyword_gap("m", WORDS), ", ").alias("missing"))


QUANTITY_RE2 = (r"[0-9]+%", r"[0-9]+x\b", r"\$[0-9]+",
                r"[0-9]+\s*(?:million|billion|thousand|k\b)", r"[0-9]+\+", r"[0-9]{4,}")


def sql_quantity(expr: str) -> str:
    counts = [f"len(regexp_extract_all({expr}, {q('(?i)' + p)}))" for p in QUANTITY_RE2]
    return f"CAST({' + '.join(counts)} AS INT)"


@query("quantity_mentions",
       f"SELECT doc_id, {sql_quantity('text')} AS n FROM documents")
def _(v):
    return v.documents().select("doc_id", X.quantity_mentions("text").alias("n"))


@query("safe_name", r"""SELECT p_partkey, substr(regexp_replace(trim(s), '[^\pL\pN_\-]', '_', 'g'), 1, 25)
       AS short, substr(regexp_replace(s, '[^\pL\pN_\-]', '_', 'g'), 1, 30) AS long FROM (SELECT
       p_partkey, ' ' || p_name || ' & ' || p_brand || ' (über) ' || p_type AS s FROM part)""")
def _(v):
    s = F.concat(F.lit(" "), "p_name", F.lit(" & "), "p_brand", F.lit(" (über) "), "p_type")
    return v.table("part").select("p_partkey", X.safe_name(s).alias("short"),
                                  X.safe_name(s, 30, strip=False).alias("long"))


@query("classify_title", with_views("v_contacts", then=f"""SELECT id, title,
       {sql_first_match('lower(title)', vocab.CONTACT_CLASSES, 'other')} AS contact_type
       FROM v_contacts"""))
def _(v):
    return v.contacts().select("id", "title", C.classify_title("title").alias("contact_type"))


@query("classify_role", with_views("v_jobs", then=f"""SELECT id, role,
       {sql_first_match('trim(lower(role))', vocab.ROLE_VARIANTS, 'data')} AS variant
       FROM v_jobs"""))
def _(v):
    return v.jobs().select("id", "role", C.classify_role("role").alias("variant"))


_HOSTS = ("https://boards.greenhouse.io/", "http://jobs.lever.co/", "https://a.MyWorkdayJobs.com/",
          "https://jobs.ashbyhq.com/", "https://smartrecruiters.com/", "https://x.example.org/")
_URL_SQL = f"{sql_list(_HOSTS)}[(p_partkey % {len(_HOSTS)}) + 1] || p_partkey"


def _urls(v):
    pick = F.get(F.array(*[F.lit(h) for h in _HOSTS]),
                 F.pmod("p_partkey", F.lit(len(_HOSTS))).cast("int"))
    return v.table("part").select(
        "p_partkey", F.concat(pick, F.col("p_partkey").cast("string")).alias("url"))


@query("classify_url", f"""SELECT p_partkey, url, {sql_first_match('lower(url)', vocab.PLATFORMS,
       'unknown')} AS platform FROM (SELECT p_partkey, {_URL_SQL} AS url FROM part)""")
def _(v):
    return _urls(v).select("p_partkey", "url", C.classify_url("url").alias("platform"))


@query("route_url", f"""SELECT p_partkey, starts_with(u, 'easy_apply::') AS direct,
       replace(u, 'easy_apply::', '') AS url,
       rtrim(replace(u, 'easy_apply::', ''), '/') || '/apply' AS apply_url FROM (SELECT p_partkey,
       CASE WHEN p_size > 25 THEN 'easy_apply::' ELSE '' END || {_URL_SQL} || '//' AS u FROM part)""")
def _(v):
    rows = _urls(v).join(v.table("part").select("p_partkey", "p_size"), "p_partkey")
    u = F.concat(F.when(F.col("p_size") > 25, F.lit("easy_apply::")).otherwise(F.lit("")),
                 "url", F.lit("//"))
    return rows.select("p_partkey", X.route_url(u).alias("r")).select("p_partkey", "r.*")


_MSG_SQL = """event_type || CASE WHEN value < 5 THEN ' Rate Limit hit' WHEN value < 10
    THEN ' 401 Unauthorized' WHEN value < 15 THEN ' quota and Forbidden' ELSE ' done' END"""


@query("classify_message", f"""SELECT event_id, {sql_first_match('lower(m)', vocab.SERVICE_ERRORS,
       'other')} AS kind FROM (SELECT event_id, {_MSG_SQL} AS m FROM events)""")
def _(v):
    value = F.col("value")
    tail = (F.when(value < 5, F.lit(" Rate Limit hit")).when(value < 10, F.lit(" 401 Unauthorized"))
            .when(value < 15, F.lit(" quota and Forbidden")).otherwise(F.lit(" done")))
    return v.table("events").select(
        "event_id", C.classify_message(F.concat("event_type", tail)).alias("kind"))


@query("template_mix", with_views("v_jobs", then="""SELECT id % 3 + 1 AS template, count(*) AS n
       FROM v_jobs GROUP BY 1"""))
def _(v):
    return v.jobs().groupBy(X.template_no("id").alias("template")).agg(F.count("*").alias("n"))


@query("labels_and_dates", with_views("v_log", "v_jobs", then="""SELECT l.id,
       upper(event[1]) || replace(event[2:], '_seen', ' Seen') AS label,
       strftime(l.created_at, '%A, %B %d') AS day_label,
       substr(coalesce(CAST(j.applied_at AS VARCHAR), CAST(j.created_at AS VARCHAR), ''), 1, 10)
       AS first_date, replace('*' || event || '*', '*', '') AS plain
       FROM v_log l LEFT JOIN v_jobs j ON j.id = l.id"""))
def _(v):
    jobs = v.jobs().select("id", "applied_at", F.col("created_at").alias("made_at"))
    return v.log().join(jobs, "id", "left").select(
        "id", X.title_label("event").alias("label"), X.date_label("created_at").alias("day_label"),
        X.first_date("applied_at", "made_at").alias("first_date"),
        X.strip_markup(F.concat(F.lit("*"), "event", F.lit("*"))).alias("plain"))


# --- ranking ---

@query("sponsors_ranked", with_views("v_companies", then="""SELECT id, name, lca_count, domain
       FROM v_companies WHERE h1b_confirmed ORDER BY lca_count DESC, name"""))
def _(v):
    return R.sponsors_ranked(v.companies()).select("id", "name", "lca_count", "domain")


@query("jobs_page", with_views("v_jobs", then="""SELECT id, company, role, applied_status FROM v_jobs
       WHERE h1b_confirmed ORDER BY id LIMIT 50"""))
def _(v):
    rows = v.jobs().where("h1b_confirmed").select("id", "company", "role", "applied_status")
    return R.page(rows, ["id"], 50)


@query("latest_doc", with_views("v_docs", then="""SELECT job_id, max(version) AS version,
       arg_max(body, version) AS body FROM v_docs GROUP BY job_id"""))
def _(v):
    return R.latest_per_key(v.docs(), ["job_id"], ["version"])


@query("cap_per_group", with_views("v_contacts", then="""SELECT title, id, name FROM v_contacts
       QUALIFY row_number() OVER (PARTITION BY title ORDER BY id) <= 3"""))
def _(v):
    return R.cap_per_group(v.contacts().select("title", "id", "name"), ["title"], ["id"], 3)


@query("append_with_ids", with_views("v_companies", then="""SELECT id, name, lca_count FROM v_companies
       WHERE c_nationkey % 2 = 0 UNION ALL SELECT (SELECT max(id) FROM v_companies
       WHERE c_nationkey % 2 = 0) + row_number() OVER (ORDER BY lca_count, name, id), name, lca_count
       FROM v_companies WHERE c_nationkey % 2 = 1"""))
def _(v):
    even = F.col("c_nationkey") % 2 == 0
    old = v.companies().where(even).select("id", "name", "lca_count")
    new = v.companies().where(~even).select("name", "lca_count", F.col("id").alias("seq"))
    return R.append_with_ids(old, new, "id", ["lca_count", "name", "seq"])


_ENTRY_BULLETS = "list_transform(range(1, CAST(o_orderkey % 3 AS BIGINT) + 2), lambda i: 'own ' || i)"
_NEW_BULLETS = "list_transform(range(1, CAST(c_custkey % 20 AS BIGINT) + 2), lambda i: 'new ' || i)"


@query("distribute_bullets", f"""WITH e AS (SELECT o_custkey AS key, o_orderkey AS pos,
         {_ENTRY_BULLETS} AS b FROM orders),
       n AS (SELECT c_custkey AS key, {_NEW_BULLETS} AS nb FROM customer),
       o AS (SELECT e.*, coalesce(sum(len(b)) OVER (PARTITION BY key ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM e)
       SELECT key, pos, array_to_string(CASE WHEN off < len(coalesce(nb, [])) THEN
         nb[off + 1 : off + len(b)] ELSE b END, '|') AS bullets FROM o LEFT JOIN n USING (key)""")
def _(v):
    def numbered(prefix, n):
        return F.transform(F.sequence(F.lit(1), n.cast("int")),
                           lambda i: F.concat(F.lit(prefix), i.cast("string")))

    entries = v.table("orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"),
        numbered("own ", F.col("o_orderkey") % 3 + 1).alias("bullets"))
    new = v.table("customer").select(
        F.col("c_custkey").alias("key"), numbered("new ", F.col("c_custkey") % 20 + 1)
        .alias("new_bullets"))
    out = R.distribute_bullets(entries, new, "key")
    return out.select("key", "pos", F.array_join("bullets", "|").alias("bullets"))


# --- exports, unions, migration ---

@query("union_sources", with_views("v_contacts", "v_job_contacts", then="""SELECT id, name, email, title,
       CAST(NULL AS BIGINT) AS job_id FROM v_contacts UNION ALL
       SELECT id, name, email, title, job_id FROM v_job_contacts"""))
def _(v):
    return union_sources(v.contacts().select("id", "name", "email", "title"),
                         v.job_contacts().select("id", "name", "email", "title", "job_id"))


@query("export_jobs", with_views("v_jobs", then="""SELECT id, company, role, jd_url, source, location,
       CASE WHEN h1b_confirmed THEN 'Yes' ELSE 'No' END AS h1b_confirmed, applied_status AS status,
       coalesce(strftime(applied_at, '%Y-%m-%d %H:%M:%S'), '') AS applied_at,
       strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM v_jobs"""))
def _(v):
    return K.export_jobs(v.jobs())


@query("migrate_schema", with_views("v_jobs", then="""SELECT id, company, 0 AS ats_score,
       CAST(NULL AS VARCHAR) AS ats_grade, false AS selected FROM v_jobs"""))
def _(v):
    old = v.jobs().drop("ats_score", "ats_grade", "selected")
    return migrate_schema(old, schemas.JOBS).select(
        "id", "company", "ats_score", "ats_grade", "selected")
