"""The data model's tables as views over the test tables.

``Views`` builds them with the DataFrame API; ``SQL`` holds the same definitions
for the oracle. Every view covers its whole base table, and its number of keys
grows with that table. Timestamps stay zone-less, so results do not depend on the
session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.classify import classify_title

TITLES = ("Senior Recruiter", "Director of Data", "Staff Engineer", "Gardener",
          "VP Engineering", "Talent Acquisition Lead", "Chris, Designer")
ROLES = (("1-URGENT", "Senior Data Engineer"), ("2-HIGH", "Data Analyst"),
         ("3-MEDIUM", "SQL Developer"), ("4-NOT SPECIFIED", "Software Engineer"))
OTHER_ROLE = "Gardener of the Year"
BODIES = (  # by discount in percent
    (0, None), (1, ""), (2, "Please provide details for [X]"),
    (3, "I DON'T HAVE the figures"), (4, "At [Company] we met"), (5, "Send e.g., the plan"))
VARIANTS = ("data", "analyst", "sql", "sde")
LANGS = ("en", "fr", "de", "es")


def _choice(key: Column, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def _percent(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("int")


class Views:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}.parquet")

    def documents(self) -> DataFrame:
        return self.table("documents")

    def pages(self) -> DataFrame:
        return self.table("pages")

    def jobs(self) -> DataFrame:
        status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
        role = F.lit(OTHER_ROLE)
        for value, name in reversed(ROLES):
            role = F.when(priority == value, F.lit(name)).otherwise(role)
        key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
        return self.table("orders").select(
            key.alias("id"),
            F.concat(F.lit("Customer "), cust, F.lit(" Inc.")).alias("company"),
            role.alias("role"),
            F.concat(F.lit("http://jobs.example.com/"), cust).alias("jd_url"),
            F.lower("o_orderpriority").alias("source"),
            F.concat(F.lit("Region "), status).alias("location"),
            F.when(status == "F", F.lit(None)).when(status == "O", F.lit(""))
            .otherwise(F.concat(F.lit("Order "), key.cast("string"), F.lit(" for "), cust))
            .alias("description"),
            priority.isin("1-URGENT", "2-HIGH").alias("h1b_confirmed"),
            F.when(status == "P", F.lit("pending")).when(status == "O", F.lit("interview"))
            .when(priority == "5-LOW", F.lit("failed")).otherwise(F.lit("applied"))
            .alias("applied_status"),
            F.when(status != "P", F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS"))
            .alias("applied_at"),
            F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
            F.lit(0).alias("ats_score"), F.lit(None).cast("string").alias("ats_grade"),
            (F.col("o_totalprice") > 300000).alias("selected"))

    def companies(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.concat("c_mktsegment", F.lit(" "), F.expr("cast(c_custkey div 5 as string)"),
                     F.lit(" Inc.")).alias("name"),
            (F.col("c_acctbal") > 0).alias("h1b_confirmed"),
            F.when(F.col("c_nationkey") > 12, F.lower("c_mktsegment")).alias("h1b_source"),
            F.col("c_acctbal").cast("bigint").alias("lca_count"),
            F.when(F.pmod("c_nationkey", F.lit(3)) == 0, F.lit(None))
            .when(F.pmod("c_nationkey", F.lit(3)) == 1, F.lit(""))
            .otherwise(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".example")))
            .alias("domain"),
            F.lit("1999-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
            "c_nationkey")

    def contacts(self) -> DataFrame:
        key = F.col("s_suppkey")
        title = _choice(F.col("s_nationkey"), TITLES)
        return self.table("supplier").select(
            key.alias("id"), F.col("s_name").alias("company"), F.col("s_name").alias("name"),
            title.alias("title"),
            F.when(key % 11 == 0, F.lit(None)).when(key % 7 == 0, F.lit(""))
            .otherwise(F.concat("s_name", F.lit("@example.com"))).alias("email"),
            classify_title(title).alias("contact_type"))

    def job_contacts(self) -> DataFrame:
        """Contacts that belong to a listing."""
        supp = F.col("l_suppkey")
        title = _choice(supp, TITLES)
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("pos"),
            F.concat(F.lit("Contact "), supp.cast("string")).alias("name"),
            title.alias("title"),
            F.when(supp % 7 == 0, F.lit(""))
            .otherwise(F.concat(F.lit("c"), supp.cast("string"), F.lit("@example.com")))
            .alias("email"),
            classify_title(title).alias("contact_type"))

    def outreach(self) -> DataFrame:
        order = F.col("l_orderkey").cast("string")
        text = F.concat(F.lit("Order "), order, F.lit(" ships as "),
                        F.col("l_partkey").cast("string"))
        body, pct = text, _percent("l_discount")
        for value, shown in reversed(BODIES):
            body = F.when(pct == value, F.lit(shown)).otherwise(body)
        subject = F.when(_percent("l_tax") == 0, F.concat(F.lit("] ] Order "), order)) \
            .when(_percent("l_tax") == 1, F.lit("")).otherwise(F.concat(F.lit("Order "), order))
        flag = F.col("l_returnflag")
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("contact_id"),
            F.when(F.col("l_linestatus") == "O", F.lit("cold_email"))
            .otherwise(F.lit("followup")).alias("outreach_type"),
            subject.alias("subject"), body.alias("body"),
            F.when(flag == "A", F.col("l_shipdate")).alias("sent_at"),
            F.when(flag == "A", F.lit("sent")).when(flag == "N", F.lit("draft"))
            .otherwise(F.lit("replied")).alias("status"),
            F.get(F.array(F.lit(3), F.lit(7), F.lit(14)),
                  F.pmod("l_linenumber", F.lit(3)).cast("int")).alias("followup_day"),
            F.col("l_shipdate").alias("created_at"))

    def log(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.concat("event_type", F.lit("_seen")).alias("event"),
            F.col("props").alias("detail"), F.col("user_id").alias("job_id"),
            F.col("ts").alias("created_at"))

    def docs(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("job_id"), F.col("turn").alias("version"),
            F.col("text").alias("body"))

    def profiles(self) -> DataFrame:
        """Every benchmark text is a profile of its own variant."""
        return self.table("benchmark").select(F.col("item_id").alias("variant"), "text")

    def role_profiles(self) -> DataFrame:
        """One profile per role variant: the latest document of a language."""
        variant = F.lit(VARIANTS[0])
        for lang, name in zip(LANGS[1:], VARIANTS[1:]):
            variant = F.when(F.col("lang") == lang, F.lit(name)).otherwise(variant)
        docs = self.documents().select(variant.alias("variant"), "doc_id", "text")
        last = docs.groupBy("variant").agg(F.max("doc_id").alias("doc_id"))
        return docs.join(last, ["variant", "doc_id"], "left_semi").select("variant", "text")

    def texts(self) -> DataFrame:
        """Documents; the variant is the document number folded onto the profiles."""
        n = self.table("benchmark").agg(F.count("*").alias("n"))
        return self.documents().select(
            F.col("doc_id").alias("id"), F.col("source").alias("company"),
            F.concat(F.lit("The "), F.col("lang"), F.lit(" "), F.col("source")).alias("role"),
            "text", F.pmod(F.col("doc_id"), n.scalar()).alias("variant"))

    def companies_in_pages(self) -> DataFrame:
        """The host label of a page as a company name."""
        host = F.regexp_extract("url", r"^https?://(?:www\.|m\.|blog\.)?([^./]*)", 1)
        return self.table("pages").select(
            F.col("page_id").alias("id"), F.concat(F.initcap(host), F.lit(", Inc.")).alias("company"),
            F.col("url").startswith("https").alias("h1b_confirmed"))

    def sponsors_in_texts(self) -> DataFrame:
        """Words of at least six letters in the benchmark texts as sponsor names."""
        words = F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{6,})"), F.lit(1))
        return self.table("benchmark").select(F.explode(words).alias("w")).distinct().select(
            F.concat("w", F.lit(" LLC")).alias("name"))


def _case(expr: str, pairs, other: str) -> str:
    whens = " ".join(f"WHEN {expr} = {k} THEN {v}" for k, v in pairs)
    return f"CASE {whens} ELSE {other} END"


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def sql_first_match(expr: str, classes, default: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({expr}, {q(w)})" for w in words)
                     + f" THEN {q(label)}" for label, words in classes)
    return f"CASE {whens} ELSE {q(default)} END"


def _title_class(expr: str) -> str:
    from leadloom import vocab
    return sql_first_match(f"lower({expr})", vocab.CONTACT_CLASSES, "other")


_ROLE = _case("o_orderpriority", [(q(k), q(v)) for k, v in ROLES], q(OTHER_ROLE))
_BODY = _case("cast(round(l_discount * 100) AS INT)", [(k, q(v)) for k, v in BODIES],
              "'Order ' || l_orderkey || ' ships as ' || l_partkey")
_T1 = f"{sql_list(TITLES)}[(s_nationkey % {len(TITLES)}) + 1]"
_T2 = f"{sql_list(TITLES)}[(l_suppkey % {len(TITLES)}) + 1]"

SQL = {
    "v_jobs": f"""SELECT o_orderkey AS id, 'Customer ' || o_custkey || ' Inc.' AS company,
        {_ROLE} AS role, 'http://jobs.example.com/' || o_custkey AS jd_url,
        lower(o_orderpriority) AS source, 'Region ' || o_orderstatus AS location,
        CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN ''
             ELSE 'Order ' || o_orderkey || ' for ' || o_custkey END AS description,
        o_orderpriority IN ('1-URGENT', '2-HIGH') AS h1b_confirmed,
        CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'interview'
             WHEN o_orderpriority = '5-LOW' THEN 'failed' ELSE 'applied' END AS applied_status,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 2 DAY END AS applied_at,
        o_orderdate AS created_at, o_orderdate AS updated_at, 0 AS ats_score,
        CAST(NULL AS VARCHAR) AS ats_grade, o_totalprice > 300000 AS selected FROM orders""",
    "v_companies": """SELECT c_custkey AS id,
        c_mktsegment || ' ' || (c_custkey // 5) || ' Inc.' AS name,
        c_acctbal > 0 AS h1b_confirmed,
        CASE WHEN c_nationkey > 12 THEN lower(c_mktsegment) END AS h1b_source,
        CAST(trunc(c_acctbal) AS BIGINT) AS lca_count,
        CASE c_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ''
             ELSE 'c' || c_custkey || '.example' END AS domain,
        TIMESTAMP '1999-01-01' AS created_at, c_nationkey FROM customer""",
    "v_contacts": f"""SELECT s_suppkey AS id, s_name AS company, s_name AS name, {_T1} AS title,
        CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN ''
             ELSE s_name || '@example.com' END AS email,
        {_title_class(_T1)} AS contact_type FROM supplier""",
    "v_job_contacts": f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS job_id,
        l_linenumber AS pos, 'Contact ' || l_suppkey AS name, {_T2} AS title,
        CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 'c' || l_suppkey || '@example.com' END AS email,
        {_title_class(_T2)} AS contact_type FROM lineitem""",
    "v_outreach": f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS job_id,
        l_suppkey AS contact_id,
        CASE l_linestatus WHEN 'O' THEN 'cold_email' ELSE 'followup' END AS outreach_type,
        CASE cast(round(l_tax * 100) AS INT) WHEN 0 THEN '] ] Order ' || l_orderkey
             WHEN 1 THEN '' ELSE 'Order ' || l_orderkey END AS subject,
        {_BODY} AS body, CASE WHEN l_returnflag = 'A' THEN l_shipdate END AS sent_at,
        CASE l_returnflag WHEN 'A' THEN 'sent' WHEN 'N' THEN 'draft' ELSE 'replied' END AS status,
        [3, 7, 14][(l_linenumber % 3) + 1] AS followup_day, l_shipdate AS created_at
        FROM lineitem""",
    "v_log": """SELECT event_id AS id, event_type || '_seen' AS event, props AS detail,
        user_id AS job_id, ts AS created_at FROM events""",
    "v_docs": "SELECT conv_id AS job_id, turn AS version, text AS body FROM conversations",
    "v_profiles": "SELECT item_id AS variant, text FROM benchmark",
    "v_role_profiles": f"""SELECT {_case('lang', [(q(k), q(n)) for k, n in zip(LANGS, VARIANTS)],
        q(VARIANTS[0]))} AS variant, arg_max(text, doc_id) AS text FROM documents GROUP BY 1""",
    "v_texts": """SELECT doc_id AS id, source AS company, 'The ' || lang || ' ' || source AS role,
        text, doc_id % (SELECT count(*) FROM benchmark) AS variant FROM documents""",
    "v_page_companies": r"""SELECT page_id AS id, upper(h[1]) || h[2:] || ', Inc.' AS company,
        url LIKE 'https%' AS h1b_confirmed FROM (SELECT page_id, url,
        regexp_extract(url, '^https?://(?:www\.|m\.|blog\.)?([^./]*)', 1) AS h FROM pages)""",
    "v_sponsors": """SELECT DISTINCT w || ' LLC' AS name FROM (SELECT
        unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM benchmark)""",
}


def with_views(*names: str, then: str) -> str:
    """The views as common tables; ``then`` may start with a comma to add more."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + then.strip()
