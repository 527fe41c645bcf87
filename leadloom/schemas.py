"""Table schemas and the additive migration of the listing table."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


LONG, INT, TEXT = T.LongType(), T.IntegerType(), T.StringType()
FLAG, TS = T.BooleanType(), T.TimestampType()

COMPANIES = _schema(
    ("id", LONG), ("name", TEXT), ("h1b_confirmed", FLAG), ("h1b_source", TEXT),
    ("lca_count", LONG), ("domain", TEXT), ("created_at", TS))

JOBS_BASE = _schema(
    ("id", LONG), ("company", TEXT), ("role", TEXT), ("jd_url", TEXT), ("source", TEXT),
    ("location", TEXT), ("description", TEXT), ("h1b_confirmed", FLAG),
    ("applied_status", TEXT), ("applied_at", TS), ("created_at", TS), ("updated_at", TS))

JOBS_ADDED = _schema(("ats_score", INT), ("ats_grade", TEXT), ("selected", FLAG))
JOBS_ADDED_DEFAULTS = {"ats_score": 0, "ats_grade": None, "selected": False}
JOBS = T.StructType(JOBS_BASE.fields + JOBS_ADDED.fields)

TAILORED_DOCS = _schema(
    ("id", LONG), ("job_id", LONG), ("resume_bullets", TEXT), ("cover_letter", TEXT),
    ("created_at", TS))

CONTACTS = _schema(
    ("id", LONG), ("job_id", LONG), ("company", TEXT), ("name", TEXT), ("title", TEXT),
    ("email", TEXT), ("source", TEXT), ("contact_type", TEXT), ("created_at", TS))

OUTREACH = _schema(
    ("id", LONG), ("job_id", LONG), ("contact_id", LONG), ("outreach_type", TEXT),
    ("subject", TEXT), ("body", TEXT), ("sent_at", TS), ("status", TEXT),
    ("followup_day", INT), ("created_at", TS))

ACTIVITY_LOG = _schema(
    ("id", LONG), ("event", TEXT), ("detail", TEXT), ("job_id", LONG), ("created_at", TS))

METADATA = _schema(
    ("job_id", LONG), ("company", TEXT), ("role", TEXT), ("jd_url", TEXT), ("source", TEXT),
    ("location", TEXT), ("h1b_confirmed", FLAG), ("applied_status", TEXT), ("folder", TEXT),
    ("created_at", TEXT), ("applied_at", TEXT), ("ats", TEXT), ("updated_at", TEXT))

_ENTRY = T.StructType([
    T.StructField("title", TEXT), T.StructField("company", TEXT), T.StructField("start", TEXT),
    T.StructField("end", TEXT), T.StructField("bullets", T.ArrayType(TEXT))])

PROFILE = T.StructType([
    T.StructField("contact", _schema(("name", TEXT), ("location", TEXT), ("phone", TEXT),
                                     ("email", TEXT), ("linkedin", TEXT), ("github", TEXT))),
    T.StructField("summary", TEXT),
    T.StructField("skills", T.ArrayType(_schema(("category", TEXT), ("skills", TEXT)))),
    T.StructField("experience", T.ArrayType(_ENTRY)),
    T.StructField("projects", T.ArrayType(T.StructType([
        T.StructField("title", TEXT), T.StructField("dates", TEXT),
        T.StructField("bullets", T.ArrayType(TEXT))]))),
    T.StructField("education", T.ArrayType(_schema(
        ("degree", TEXT), ("school", TEXT), ("location", TEXT), ("date", TEXT)))),
])

MAIL_PAYLOAD = T.StructType([T.StructField("data", T.StructType([
    T.StructField("emails", T.ArrayType(_schema(
        ("first_name", TEXT), ("last_name", TEXT), ("position", TEXT), ("value", TEXT))))]))])

PEOPLE_PAYLOAD = T.StructType([T.StructField("people", T.ArrayType(_schema(
    ("name", TEXT), ("email", TEXT), ("title", TEXT))))])

TABLES = {
    "companies": COMPANIES, "jobs": JOBS, "tailored_docs": TAILORED_DOCS,
    "contacts": CONTACTS, "outreach": OUTREACH, "activity_log": ACTIVITY_LOG,
}
UNIQUE_KEYS = {"companies": "name", "jobs": "jd_url"}
