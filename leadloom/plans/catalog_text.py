"""Scores, extraction and text parsing over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import text as X
from leadloom.functions.profile import profile_text
from leadloom.functions.scoring import DEFAULT_VOCAB, ScoreVocab
from leadloom.functions.sqlfuncs import register_sql_functions, register_table_functions
from leadloom.operators.mutate import score_writeback
from leadloom.operators.score import flat_scores, score_docs, topk_scored
from leadloom.plans.catalog_rows import sql_hits, sql_quantity
from leadloom.plans import flows
from leadloom.plans.catalog_tables import SENDER, sql_email_prompt
from leadloom.plans.registry import ORACLE, query
from leadloom.plans.views import Views, q, sql_first_match, sql_list, with_views
from leadloom.schemas import JOBS
from leadloom.sources.pages import CardSpec, Field, TagField, extract_cards, \
    extract_nested_cards, extract_table_rows, extract_text, listings_full, listings_title_only
from leadloom.sources.tables import union_sources

# A short dictionary whose words occur often in the test prose.
TEST_VOCAB = ScoreVocab(
    hard=("the", "tion", "ing", "and", "ment", "eau", "ich", "sch", "ción", "über"),
    soft=("on", "er", "th"), verbs=("he", "re", "an", "st"),
    levels=(("junior", ("ich", "sch")), ("mid", ("eau",)), ("senior", ("ción", "os")),
            ("staff", ("über",)), ("manager", ("ment",))),
    degrees=(("bachelor", ("lich", "keit")), ("master", ("aux",)), ("phd", ("mente",)),
             ("relevant", ("ble", "esh"))))


# --- scores ---

def _sql_labels(expr: str, classes) -> str:
    cases = ", ".join(
        "CASE WHEN " + " OR ".join(f"contains({expr}, {q(w)})" for w in words)
        + f" THEN {q(label)} END" for label, words in classes)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def _sql_count(expr: str, words) -> str:
    return f"len({sql_hits(expr, words)})"


def sql_scored(v: ScoreVocab, docs: str = "v_texts", profiles: str = "v_profiles") -> str:
    """Common tables that end in ``r``: one row per document with all score parts."""
    stop = sql_list(v.stop_words)
    return f"""
    d0 AS (SELECT id, company, role, variant, translate(lower(text), '-_', '  ') AS t FROM {docs}),
    d AS (SELECT * EXCLUDE (t), {sql_hits('t', v.hard)} AS hard, {_sql_labels('t', v.levels)} AS lv,
      {_sql_labels('t', v.degrees)} AS dg FROM d0),
    p0 AS (SELECT variant, text AS raw, translate(lower(text), '-_', '  ') AS pt FROM {profiles}),
    p AS (SELECT variant, pt, {sql_hits('pt', v.hard)} AS phard, {_sql_count('pt', v.soft)} AS n_soft,
      {_sql_count('pt', v.verbs)} AS n_verbs, {_sql_labels('pt', v.levels)} AS plv,
      {_sql_labels('pt', v.degrees)} AS pdg, {sql_quantity('raw')} AS n_quantity FROM p0),
    j AS (SELECT *, list_filter(hard, lambda k: list_contains(phard, k)) AS m,
      list_filter(hard, lambda k: NOT list_contains(phard, k)) AS x,
      list_filter(dg, lambda k: list_contains(pdg, k)) AS sd,
      list_filter(list_distinct(string_split_regex(translate(lower(role), '-_', '  '), '\\s+')),
        lambda w: w <> '' AND NOT list_contains({stop}, w)) AS w FROM d JOIN p USING (variant)),
    k AS (SELECT *, len(m) AS n_matched, len(hard) AS n_required,
      CASE WHEN len(hard) > 0 THEN least(40, CAST(trunc(len(m) / len(hard) * 40) AS INT)) ELSE 25 END
        AS hard_skills,
      least(15, CAST(trunc((n_soft + n_verbs) * CAST(1.5 AS DOUBLE)) AS INT)) AS soft_skills,
      CASE WHEN list_has_any(lv, plv) THEN 15 WHEN len(lv) > 0 THEN 5 ELSE 10 END AS experience_level,
      CASE WHEN len(dg) = 0 THEN 8 WHEN len(sd) = 0 THEN 4 WHEN sd[1] IN ('master', 'phd') THEN 10
        ELSE 7 END AS education,
      least(10, n_quantity * 2) AS quantified,
      least(10, CAST(trunc(len(list_filter(w, lambda e: contains(pt, e)))
        / greatest(len(w), 1) * 10) AS INT)) AS title_match FROM j),
    r AS (SELECT *, least(100, hard_skills + soft_skills + experience_level + education + quantified
      + title_match) AS score, list_sort(m)[1:20] AS mk, list_sort(x)[1:15] AS xk FROM k),
    s AS (SELECT *, CASE WHEN score >= 85 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 65 THEN 'C'
      WHEN score >= 50 THEN 'D' ELSE 'F' END AS grade,
      CASE {' '.join(f'WHEN score >= {n} THEN {q(t)}' for n, t in vocab.ADVICE_BANDS)}
      ELSE {q(vocab.ADVICE_DEFAULT)} END AS recommendation FROM r)"""


_PARTS = ("hard_skills, soft_skills, experience_level, education, quantified, title_match, n_matched, "
          "n_required, n_soft, n_verbs, n_quantity")
_FLAT = f"""SELECT id, score, grade, recommendation, {_PARTS},
    array_to_string(mk, ', ') AS matched_keywords, array_to_string(xk, ', ') AS missing_keywords FROM s"""


def _scored_sql(v: ScoreVocab, then: str) -> str:
    return with_views("v_texts", "v_profiles", then="," + sql_scored(v) + " " + then)


def scored(v: Views, words: ScoreVocab = DEFAULT_VOCAB) -> DataFrame:
    return score_docs(v.texts(), v.profiles(), v=words, spread=["id"])


@query("score_docs", _scored_sql(DEFAULT_VOCAB, _FLAT))
def _(v):
    return flat_scores(scored(v), "id")


@query("score_docs_short_vocab", _scored_sql(TEST_VOCAB, _FLAT))
def _(v):
    return flat_scores(scored(v, TEST_VOCAB), "id")


@query("score_threshold", _scored_sql(TEST_VOCAB, "SELECT id, score, grade FROM s WHERE score >= 65"))
def _(v):
    rows = scored(v, TEST_VOCAB).select("id", "score.score", "score.grade")
    return rows.where(F.col("score") >= 65)


@query("score_writeback", with_views("v_jobs", "v_texts", "v_profiles", then="," + sql_scored(TEST_VOCAB)
       + """ SELECT j.id, coalesce(s.score, 0) AS ats_score, s.grade AS ats_grade
       FROM v_jobs j LEFT JOIN s ON s.id = j.id"""))
def _(v):
    scores = scored(v, TEST_VOCAB).select("id", "score.score", "score.grade", F.lit(1).alias("seq"))
    earlier = scores.select("id", F.lit(1).alias("score"), F.lit("F").alias("grade"), F.lit(0).alias("seq"))
    return score_writeback(v.jobs(), earlier.unionByName(scores), ["seq"]).select("id", "ats_score", "ats_grade")


@query("topk_scored", _scored_sql(DEFAULT_VOCAB, """, t AS (SELECT *, row_number() OVER (
    ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0 ORDER BY score DESC, id LIMIT 20)
    SELECT rank, id, role, company, score, grade, recommendation,
    array_to_string(xk[1:5], ', ') AS missing_keywords,
    lpad(CAST(rank AS VARCHAR), 3, ' ') || '.  ' || lpad(CAST(score AS VARCHAR), 3, ' ') || '/100  ('
    || grade || ')  ' || rpad(substr(role, 1, 35), 36, ' ') || ' '
    || rpad(substr(company, 1, 20), 22, ' ') || ' '
    || CASE WHEN len(xk) = 0 THEN '—' ELSE array_to_string(xk[1:3], ', ') END AS line FROM t"""))
def _(v):
    return topk_scored(scored(v), 20, 0)


_PENDING = f"""pj AS (SELECT id, company, role,
    {sql_first_match('trim(lower(role))', vocab.ROLE_VARIANTS, 'data')} AS variant,
    CASE WHEN coalesce(description, '') = '' THEN 'Role: ' || role || ' at ' || company
      ELSE description END AS text FROM v_jobs WHERE applied_status = 'pending' AND h1b_confirmed)"""


@query("score_pending", with_views("v_jobs", "v_role_profiles", then=f""", {_PENDING},
       rp AS (SELECT * FROM v_role_profiles WHERE variant <> 'sql'),
       pk AS (SELECT * REPLACE (CASE WHEN variant IN (SELECT variant FROM rp) THEN variant
         ELSE 'data' END AS variant) FROM pj),""" + sql_scored(DEFAULT_VOCAB, "pk", "rp") + " " + _FLAT))
def _(v):
    profiles = v.role_profiles().where("variant <> 'sql'")
    return flat_scores(flows.score_pending(v.jobs(), profiles), "id")


@query("prompt_flow", with_views("v_jobs", "v_docs", "v_job_contacts", "v_role_profiles", then=f"""
    , {_PENDING}, w AS (SELECT pj.*, p.text AS profile, pj.text AS description FROM pj
      JOIN v_role_profiles p USING (variant) WHERE id NOT IN (SELECT job_id FROM v_docs))
    SELECT job_id, contact_id, template, prompt FROM (SELECT w.id AS job_id, c.id AS contact_id,
      w.id % 3 + 1 AS template, {sql_email_prompt('w.id % 3 + 1')} AS prompt
      FROM w JOIN v_job_contacts c ON c.job_id = w.id WHERE email <> ''
      AND contact_type IN ('hr', 'hiring_manager', 'team_lead'))"""))
def _(v):
    return flows.prompts(v.jobs(), v.docs(), v.job_contacts(), v.role_profiles(), SENDER)


# --- pages ---

NAV_CARDS = CardSpec(r"(?s)<li>(.*?)</li>", (
    Field("role", r"(?s)<a[^>]*>(.*?)</a>", True),
    Field("jd_url", r"<a[^>]*?href=\"([^\"]*)\"", True, False),
    Field("location", r"<span class=\"location\">(.*?)</span>")))

def sql_decoded(expr: str) -> str:
    for entity, text in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&nbsp;", " "), ("&amp;", "&")):
        expr = f"replace({expr}, {q(entity)}, {q(text)})"
    return expr


SQL_WS = q(X.WHITESPACE)


def sql_markup(expr: str, sep: str) -> str:
    pieces = f"list_transform(string_split_regex({expr}, '<[^>]*>'), " \
             f"lambda p: trim({sql_decoded('p')}, {SQL_WS}))"
    return f"array_to_string(list_filter({pieces}, lambda p: p <> ''), {sep})"


_NAV = f"""WITH c AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS cs FROM pages),
    x AS (SELECT page_id, unnest(cs) AS card, generate_subscripts(cs, 1) - 1 AS pos FROM c)
    SELECT page_id, CAST(pos AS INT) AS pos,
      {sql_markup("regexp_extract(card, '(?s)<a[^>]*>(.*?)</a>', 1)", "''")} AS role,
      {sql_decoded("regexp_extract(card, '<a[^>]*?href=\"([^\"]*)\"', 1)")} AS jd_url, '' AS location
    FROM x WHERE card LIKE '%<a %'"""


@query("extract_cards", _NAV)
def _(v):
    return extract_cards(v.pages(), NAV_CARDS)


@query("extract_cards_nested", _NAV)
def _(v):
    return extract_nested_cards(v.pages(), "li", "", (
        TagField("role", "a", required=True), TagField("jd_url", "a", attr="href", required=True),
        TagField("location", "span", "location")))


@query("extract_text", f"""SELECT page_id, {sql_markup(
    "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)", 'chr(10)')} AS text FROM pages""")
def _(v):
    return extract_text(v.pages(), "article")


def _customer_pages(v: Views) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    row = F.concat(F.lit('<tr class="r"><td><div><a title="t" href="/firm/'), key, F.lit('?x=1">'), F.col("c_name"),
                   F.lit(" &amp; Caf&eacute; <i>&#8217;</i></a></div></td><td>"),
                   F.format_number(F.abs("c_acctbal").cast("bigint"), 0),
                   F.lit(" filings</td><td>x</td></tr><tr><td>short</td></tr>"))
    return v.table("customer").select(F.col("c_custkey").alias("page_id"), F.concat(
        F.lit("<table><tr><td><a href='/no'>no</a></td><td>1</td><td>2</td></tr></table>"
              "<table id='t' class='wide tbl'><tr><th>Name</th></tr>"), row, F.lit("</table>")).alias("html"))


@query("extract_table_rows", """SELECT c_custkey AS page_id, 1 AS pos, c_name || ' & Café’' AS name,
    CAST(trunc(abs(c_acctbal)) AS BIGINT) AS lca_count,
    'https://sponsors.example.com/firm/' || c_custkey || '?x=1' AS company_url, '' AS domain
    FROM customer""")
def _(v):
    return extract_table_rows(_customer_pages(v), "https://sponsors.example.com")


def _board_pages(v: Views) -> DataFrame:
    """One page per order with a full card, a card without a link and a title-only card."""
    key, name = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    full = F.concat(
        F.lit('<div data-x="1" class="base-card x"><div class="in"><h3 class="base-search-card__title"> Role <b>'),
        name, F.lit('</b></h3></div><h4 class="base-search-card__subtitle"> <a href="#">Firm &amp; '), key,
        F.lit('</a></h4><div><span class="job-search-card__location">Town</span></div>'
              '<a href="https://b.example/j/'), key, F.lit('?ref=1" class="base-card__full-link">x</a></div>'))
    broken = F.lit('<div class="base-card"><h3 class="base-search-card__title">No link</h3></div>')
    item = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(' data-jk="'), key, F.lit('"'))) \
        .otherwise(F.lit(""))
    title = F.concat(F.lit('<div class="job_seen_beacon"><div><h2 class="jobTitle"><a'), item, F.lit(">"), name,
                     F.lit('</a></h2></div><div class="companyLocation">At <b>sea</b></div></div>'))
    return v.table("orders").select(F.col("o_orderkey").alias("page_id"),
                                    F.concat(full, broken, title).alias("html"))


@query("scrape_union", """SELECT o_orderkey AS page_id, 'Role' || o_orderpriority AS role,
    'Firm & ' || o_orderkey AS company, 'Town' AS location,
    'https://b.example/j/' || o_orderkey AS jd_url, 'board_a' AS source FROM orders UNION ALL
    SELECT o_orderkey, o_orderpriority, '', 'Atsea', CASE WHEN o_orderkey % 2 = 0
    THEN 'https://v.example/view?jk=' || o_orderkey ELSE '' END, 'board_b' FROM orders""")
def _(v):
    pages = _board_pages(v)
    both = union_sources(listings_full(pages, "board_a"),
                         listings_title_only(pages, "board_b", "https://v.example/view?jk="))
    return both.select("page_id", "role", "company", "location", "jd_url", "source")


@query("ingest_flow", """SELECT *, row_number() OVER (ORDER BY jd_url) AS id, 0 AS ats_score, false AS selected
    FROM (SELECT 'https://b.example/j/' || o_orderkey AS jd_url,
    'Role' || o_orderpriority AS role, 'Firm & ' || o_orderkey AS company, 'board_a' AS source,
    false AS h1b_confirmed, 'pending' AS applied_status, '' AS description FROM orders UNION ALL
    SELECT 'https://v.example/view?jk=' || o_orderkey, o_orderpriority, '', 'board_b', true, 'pending',
    '' FROM orders WHERE o_orderkey % 2 = 0) t""")
def _(v):
    pages = _board_pages(v)
    merged = flows.ingest(
        v.spark.createDataFrame([], JOBS),
        [listings_full(pages, "board_a"),
         listings_title_only(pages, "board_b", "https://v.example/view?jk=")],
        v.sponsors_in_texts(), "2024-01-01 00:00:00", ["source", "page_id", "pos"])
    return merged.select("jd_url", "role", "company", "source", "h1b_confirmed", "applied_status",
                         "description", "id", "ats_score", "selected")


def _linked_pages(v: Views) -> DataFrame:
    key = F.col("page_id").cast("string")
    tail = F.get(F.array(
        F.concat(F.lit("<a href='https://boards.greenhouse.io/x/"), key, F.lit("'>")),
        F.concat(F.lit(" https://jobs.lever.co/y/"), key, F.lit(" greenhouse.io ")),
        F.concat(F.lit('"https://a.myworkdayjobs.com/z">https://jobs.lever.co/w/'), key, F.lit("<")),
        F.lit("none")), F.pmod("page_id", F.lit(4)).cast("int"))
    return v.pages().select("page_id", "url", F.concat("html", tail).alias("html"))


@query("link_scan", """SELECT page_id, CASE page_id % 4
    WHEN 0 THEN 'https://boards.greenhouse.io/x/' || page_id
    WHEN 1 THEN 'https://jobs.lever.co/y/' || page_id
    WHEN 2 THEN 'https://jobs.lever.co/w/' || page_id ELSE url END AS apply_url FROM pages""")
def _(v):
    return _linked_pages(v).select("page_id", X.link_scan("html", "url").alias("apply_url"))


# --- labelled text, bullets, profiles ---

_RAW = """CASE WHEN role = 'user' THEN 'Subject: ' || substr(text, 1, 40) || chr(10) || chr(10) || text
    WHEN role = 'assistant' THEN 'intro' || chr(10) || '[subject:] ] Hi ' || conv_id || ' ' || chr(10)
      || ' [body:]' || chr(10) || text || chr(10) || '---' || chr(10) || '*Note: x' || chr(10) || 'y'
    ELSE ' ' || text END"""


def _raw_labelled(v: Views) -> DataFrame:
    text, key = F.col("text"), F.col("conv_id").cast("string")
    raw = (F.when(F.col("role") == "user",
                  F.concat(F.lit("Subject: "), F.substring(text, 1, 40), F.lit("\n\n"), text))
           .when(F.col("role") == "assistant", F.concat(
               F.lit("intro\n[subject:] ] Hi "), key, F.lit(" \n [body:]\n"), text,
               F.lit("\n---\n*Note: x\ny")))
           .otherwise(F.concat(F.lit(" "), text)))
    return v.table("conversations").select("conv_id", "turn", raw.alias("raw"))


@query("parse_labelled", f"""WITH r AS (SELECT conv_id, turn, {_RAW} AS raw FROM conversations),
    l AS (SELECT *, string_split(raw, chr(10)) AS ls, contains(lower(raw), '[subject')
      OR starts_with(lower(raw), 'subject:') AS lab FROM r),
    t AS (SELECT *, list_transform(ls, lambda e: trim(e, {SQL_WS})) AS tr FROM l),
    i AS (SELECT *, list_position(list_transform(tr, lambda e:
        regexp_matches(e, '(?i)^\\[?subject[:\\]]+')), true) AS si,
      list_position(list_transform(tr, lambda e: regexp_matches(e, '(?i)^\\[?body[:\\]]+')), true) AS bi
      FROM t),
    o AS (SELECT conv_id, turn, CASE WHEN lab AND si > 0 THEN trim(ltrim(regexp_replace(tr[si],
        '(?i)^\\[?subject[:\\]]+\\s*\\]?\\s*', ''), ']'), {SQL_WS}) ELSE '' END AS subject,
      CASE WHEN lab AND bi > 0 THEN trim(array_to_string(ls[bi + 1 :], chr(10)), {SQL_WS})
        WHEN lab AND si > 0 THEN trim(array_to_string(ls[si + 1 :], chr(10)), {SQL_WS})
        ELSE raw END AS b FROM i)
    SELECT conv_id, turn, subject,
      trim(regexp_replace(b, '(?s)\\n---\\n\\*.*$', ''), {SQL_WS}) AS body FROM o""")
def _(v):
    rows = _raw_labelled(v).select("conv_id", "turn", X.parse_labelled("raw").alias("p"))
    return rows.select("conv_id", "turn", "p.subject", "p.body")


@query("extract_bullets", f"""WITH l AS (SELECT doc_id, list_filter(string_split_regex(
      replace(text, chr(10), chr(10) || '- '), {q(X.LINE_BREAK)}), lambda e:
      regexp_matches(trim(e, {SQL_WS}), '^[-•–]') AND length(trim(e, {SQL_WS})) > 10) AS b FROM documents)
    SELECT doc_id, len(b) AS n, array_to_string(list_transform(b, lambda e:
      trim(ltrim(e, '•-– '), {SQL_WS})), '|') AS bullets FROM l""")
def _(v):
    listed = F.replace("text", F.lit("\n"), F.lit("\n- "))
    rows = v.documents().select("doc_id", X.extract_bullets(listed).alias("b"))
    return rows.select("doc_id", F.size("b").alias("n"), F.array_join("b", "|").alias("bullets"))


def _profile_structs(v: Views) -> DataFrame:
    """A nested profile per order: two positions, a project for some, one degree."""
    key = F.col("o_orderkey").cast("string")
    price = F.col("o_totalprice").cast("bigint").cast("string")
    S, lit = F.struct, F.lit

    def position(title: str):
        return S(F.concat(lit(title), key).alias("title"), lit("Firm").alias("company"),
                 lit("2001").alias("start"), lit("2005").alias("end"),
                 F.array(F.concat(lit("Handled "), price), F.col("o_orderpriority")).alias("bullets"))

    project = S(lit("Sorter").alias("title"), lit("2004").alias("dates"),
                F.array(F.concat(lit("Order "), key)).alias("bullets"))
    projects = F.when(F.col("o_orderstatus") == "P", F.array(project))
    return v.table("orders").select("o_orderkey", S(
        S(F.concat(lit("Person "), key).alias("name"), lit("Town").alias("location"),
          lit("000").alias("phone"), F.concat(key, lit("@p.example")).alias("email"),
          lit("in/x").alias("linkedin"), lit("gh/x").alias("github")).alias("contact"),
        F.concat(lit("Works on "), F.col("o_orderpriority")).alias("summary"),
        F.array(S(lit("Tools").alias("category"), lit("a, b").alias("skills")),
                S(lit("Area").alias("category"), F.col("o_orderstatus").alias("skills")))
        .alias("skills"),
        F.array(position("Lead "), position("Clerk ")).alias("experience"),
        projects.alias("projects"),
        F.array(S(lit("MSc").alias("degree"), lit("School").alias("school"),
                  lit("Town").alias("location"), lit("1999").alias("date"))).alias("education"))
        .alias("profile"))


_POSITION = """chr(10) || '{0} ' || o_orderkey || '  |  Firm  |  2001 – 2005' || chr(10) || '• Handled '
    || CAST(trunc(o_totalprice) AS BIGINT) || chr(10) || '• ' || o_orderpriority || chr(10)"""


@query("profile_text", f"""SELECT o_orderkey, 'Person ' || o_orderkey || chr(10) || 'Town | 000 | '
    || o_orderkey || '@p.example | in/x' || chr(10) || chr(10) || 'SUMMARY' || chr(10) || 'Works on '
    || o_orderpriority || chr(10) || chr(10) || 'SKILLS' || chr(10) || 'Tools: a, b' || chr(10)
    || 'Area: ' || o_orderstatus || chr(10) || chr(10) || 'EXPERIENCE' || chr(10)
    || {_POSITION.format('Lead')} || {_POSITION.format('Clerk')}
    || CASE WHEN o_orderstatus = 'P' THEN chr(10) || 'PROJECTS' || chr(10) || chr(10)
      || 'Sorter  (2004)' || chr(10) || '• Order ' || o_orderkey || chr(10) ELSE '' END
    || chr(10) || 'EDUCATION' || chr(10) || 'MSc — School (1999)' AS text FROM orders""")
def _(v):
    return _profile_structs(v).select("o_orderkey", profile_text("profile").alias("text"))


# --- the same for SQL users ---

@query("sql_parse_labelled", ORACLE["parse_labelled"])
def _(v):
    register_sql_functions(v.spark)
    return v.spark.sql("SELECT conv_id, turn, p.subject, p.body FROM "
                       "(SELECT conv_id, turn, parse_labelled(raw) AS p FROM {rows})", rows=_raw_labelled(v))


@query("sql_extract_bullets", ORACLE["extract_bullets"])
def _(v):
    register_sql_functions(v.spark)
    return v.spark.sql("SELECT doc_id, size(b) AS n, array_join(b, '|') AS bullets FROM (SELECT doc_id, "
                       "extract_bullets(replace(text, '\n', '\n- ')) AS b FROM {docs})", docs=v.documents())


@query("sql_top_scored", _scored_sql(DEFAULT_VOCAB, """, t AS (SELECT *, row_number() OVER (
    ORDER BY score DESC, id) AS rank FROM s WHERE score >= 30 ORDER BY score DESC, id LIMIT 25)
    SELECT CAST(rank AS INT) AS rank, id, role, company, score, grade FROM t"""))
def _(v):
    scored(v).select("id", "role", "company", "score.score", "score.grade").createOrReplaceTempView("leadloom_scored")
    v.jobs().createOrReplaceTempView("leadloom_jobs")
    v.outreach().createOrReplaceTempView("leadloom_outreach")
    v.job_contacts().createOrReplaceTempView("leadloom_contacts")
    register_table_functions(v.spark, "leadloom_jobs", "leadloom_outreach", "leadloom_contacts", "leadloom_scored")
    return v.spark.sql("SELECT * FROM top_scored(25, 30)")
