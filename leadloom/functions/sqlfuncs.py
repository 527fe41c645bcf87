"""The scalar functions for SQL users, as Spark SQL functions (no Python UDF).

Each body is an SQL expression that Catalyst inlines into the calling query.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from leadloom import vocab
from leadloom.functions.text import LINE_BREAK, WHITESPACE


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _removed(expr: str, parts: tuple[str, ...]) -> str:
    for part in parts:
        expr = f"replace({expr}, {_text(part)}, '')"
    return expr


def _stripped(expr: str) -> str:
    """Without white space at either end: the same characters as in the Column form."""
    return f"btrim({expr}, {_text(WHITESPACE)})"


def _first_match(expr: str, classes, default: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({expr}, {_text(w)})" for w in words)
        + f" THEN {_text(label)}" for label, words in classes)
    return f"CASE {whens} ELSE {_text(default)} END"


def _bands(expr: str, bands, default: str) -> str:
    whens = " ".join(f"WHEN {expr} >= {floor} THEN {_text(label)}" for floor, label in bands)
    return f"CASE {whens} ELSE {_text(default)} END"


def definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (argument list, result type, body)."""
    mentions = " + ".join(f"regexp_count(x, {_text('(?i)' + p)})"
                          for p in vocab.QUANTITY_PATTERNS)
    return {
        "norm_company": ("x STRING", "STRING",
                         _stripped(_removed("lower(x)", vocab.COMPANY_REMOVALS))),
        "norm_sponsor": ("x STRING", "STRING",
                         _stripped(_removed("lower(x)", vocab.SPONSOR_REMOVALS))),
        "domain_guess": ("x STRING", "STRING",
                         f"concat({_removed('lower(x)', vocab.DOMAIN_REMOVALS)}, '.com')"),
        "url_canonical": ("x STRING", "STRING", "substring_index(x, '?', 1)"),
        "digits_to_int": ("x STRING", "BIGINT",
                          "coalesce(try_cast(regexp_replace(x, '[^0-9]', '') AS BIGINT), 0L)"),
        "norm_text": ("x STRING", "STRING", "translate(lower(x), '-_', '  ')"),
        "quantity_mentions": ("x STRING", "INT", mentions),
        "classify_title": ("x STRING", "STRING",
                           _first_match("coalesce(lower(x), '')", vocab.CONTACT_CLASSES, "other")),
        "classify_role": ("x STRING", "STRING",
                          _first_match(f"coalesce({_stripped('lower(x)')}, '')", vocab.ROLE_VARIANTS,
                                       vocab.ROLE_DEFAULT)),
        "classify_url": ("x STRING", "STRING",
                         _first_match("coalesce(lower(x), '')", vocab.PLATFORMS, "unknown")),
        "classify_message": ("x STRING", "STRING",
                             _first_match("coalesce(lower(x), '')", vocab.SERVICE_ERRORS, "other")),
        "score_advice": ("x INT", "STRING", _bands("x", vocab.ADVICE_BANDS, vocab.ADVICE_DEFAULT)),
        "strip_space": ("x STRING", "STRING", _stripped("x")),
        "yes_no": ("x BOOLEAN", "STRING", "IF(coalesce(x, false), 'Yes', 'No')"),
        "score_grade": ("x INT", "STRING", _bands("x", vocab.GRADE_BANDS, vocab.GRADE_DEFAULT)),
    }


_SCHEME = "[A-Za-z][A-Za-z0-9+.\\-]*"


def _re(pattern: str) -> str:
    return _text(pattern)


def _labelled() -> dict[str, tuple[str, str, str]]:
    """``parse_labelled`` in steps: where the labels are, then what stands behind them."""
    def label(word: str) -> str:
        return _re(rf"(?i)^\[?{word}[:\]]+")

    def at(word: str) -> str:
        return f"array_position(transform(ls, e -> {_stripped('e')} RLIKE {label(word)}), true)"

    after = "array_join(slice(ls, CAST({0} + 1 AS INT), greatest(size(ls), 1)), '\\n')"
    line = (f"regexp_replace({_stripped('get(ls, CAST(s - 1 AS INT))')}, "
            + _re(r"(?i)^\[?subject[:\]]+\s*\]?\s*") + ", '')")
    body = (f"CASE WHEN lab AND b > 0 THEN {_stripped(after.format('b'))} "
            f"WHEN lab AND s > 0 THEN {_stripped(after.format('s'))} ELSE x END")
    pair = (f"named_struct('subject', CASE WHEN lab AND s > 0 THEN {_stripped(f"ltrim(']', {line})")} ELSE '' END, "
            f"'body', {_stripped(f'strip_note({body})')})")
    kind = "STRUCT<subject: STRING, body: STRING>"
    return {
        "strip_note": ("x STRING", "STRING", f"regexp_replace(x, {_re(r'(?s)\n---\n\*.*$')}, '')"),
        "_labelled_parts": ("x STRING, ls ARRAY<STRING>, lab BOOLEAN, s BIGINT, b BIGINT", kind, pair),
        "_labelled_lines": ("x STRING, ls ARRAY<STRING>", kind,
                            "_labelled_parts(x, ls, contains(lower(x), '[subject') OR startswith(lower(x), 'subject:'), "
                            f"{at('subject')}, {at('body')})"),
        "parse_labelled": ("x STRING", kind, "_labelled_lines(x, split(x, '\\n', -1))")}


def more_definitions() -> dict[str, tuple[str, str, str]]:
    """URLs, names, labels, dates, files and keywords: name -> (argument list, result type, body).

    A name may use those before it.
    """
    root = f"regexp_extract(base, {_re(f'^{_SCHEME}://[^/?#]*')}, 0)"
    path = f"regexp_extract(base, {_re(f'^{_SCHEME}://[^/?#]*([^?#]*)')}, 1)"
    stripped = _stripped("e")
    filled = [f"nullif({c}, '')" for c in "ab"]
    hard = ", ".join(f"IF(contains(x, {_text(w)}), {_text(w)}, NULL)" for w in vocab.HARD_SKILLS)
    return {
        "_host": ("a STRING", "STRING",
                  f"replace(lower(IF(startswith(a, '['), regexp_extract(a, {_re(r'^\[([^\]]*)')}, 1), "
                  "substring_index(a, ':', 1))), 'www.', '')"),
        "url_host": ("x STRING", "STRING",
                     "_host(regexp_extract(IF(contains(x, '://'), x, concat('https://', x)), "
                     f"{_re(f'^{_SCHEME}://(?:[^/?#]*@)?([^/?#]*)')}, 1))"),
        "url_join": ("base STRING, x STRING", "STRING",
                     f"CASE WHEN coalesce(x, '') = '' THEN base WHEN x RLIKE {_re(f'^{_SCHEME}:')} THEN x "
                     f"WHEN startswith(x, '//') THEN concat(substring_index(base, ':', 1), ':', x) "
                     f"WHEN startswith(x, '/') THEN concat({root}, x) WHEN startswith(x, '?') THEN concat({root}, {path}, x) "
                     f"WHEN startswith(x, '#') THEN concat(substring_index(base, '#', 1), x) "
                     f"ELSE concat({root}, regexp_replace({path}, '[^/]*$', ''), "
                     f"IF({path} = '', '/', ''), x) END"),
        "safe_name": ("x STRING, n INT DEFAULT 25", "STRING",
                      f"substring(regexp_replace({_stripped('x')}, {_re(r'[^\p{L}\p{N}_\-]')}, '_'), 1, n)"),
        "default_text": ("description STRING, role STRING, company STRING", "STRING",
                         "coalesce(nullif(description, ''), concat('Role: ', role, ' at ', company))"),
        "_first_word": ("x STRING, w STRING", "STRING",
                        f"IF(coalesce(w, '') = '' OR x = {_text(vocab.PLACEHOLDER_CONTACT)}, 'there', w)"),
        "first_name": ("x STRING", "STRING", f"_first_word(x, regexp_extract({_stripped('x')}, {_re(r'^\S+')}, 0))"),
        "title_label": ("x STRING", "STRING",
                        f"array_join(transform(split(replace(x, '_', ' '), {_re(r'(?<=\P{L})(?=\p{L})')}, -1), "
                        "w -> initcap(w)), '')"),
        "date_label": ("x TIMESTAMP", "STRING", "date_format(x, 'EEEE, MMMM dd')"),
        "first_date": ("a STRING, b STRING", "STRING", f"substring(coalesce({', '.join(filled)}, ''), 1, 10)"),
        "extract_bullets": ("x STRING", "ARRAY<STRING>",
                            f"transform(filter(split(x, {_text(LINE_BREAK)}, -1), e -> {stripped} RLIKE '^[-•–]' AND "
                            f"length({stripped}) > 10), e -> {_stripped('ltrim(' + _text('•-– ') + ', e)')})"),
        "draft_file_name": ("kind STRING, day INT, contact_type STRING, id BIGINT", "STRING",
                            "CASE WHEN kind = 'cold_email' THEN concat('cold_email_', coalesce(contact_type, 'None'), '.txt') "
                            "WHEN kind = 'followup' AND coalesce(day, 0) <> 0 THEN concat('followup_day', day, '.txt') "
                            "ELSE concat(kind, '_', id, '.txt') END"),
        "_keywords": ("x STRING", "ARRAY<STRING>", f"array_compact(array({hard}))"),
        "keyword_match": ("x STRING", "ARRAY<STRING>", "_keywords(norm_text(x))"),
        **_labelled()}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the functions in this session; returns their names (those with ``_`` are parts of others)."""
    found = {**definitions(), **more_definitions()}
    for name, (args, result, body) in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} "
                  f"RETURN {body}")
    return sorted(n for n in found if not n.startswith("_"))


def table_definitions(jobs: str, outreach: str, contacts: str, scored: str) -> dict[str, tuple[str, str, str]]:
    """name -> (argument list, result columns, query) over the named tables or views."""
    due = ("SELECT o.id, o.job_id, o.contact_id, o.followup_day, j.company, j.role "
           f"FROM {outreach} o JOIN {jobs} j ON j.id = o.job_id "
           "WHERE o.outreach_type = 'followup' AND o.status = 'draft'")
    due_columns = "id BIGINT, job_id BIGINT, contact_id BIGINT, followup_day INT, company STRING, role STRING"
    return {
        "pending_jobs": ("", "id BIGINT, company STRING, role STRING, jd_url STRING, description STRING",
                         f"SELECT id, company, role, jd_url, description FROM {jobs} "
                         "WHERE applied_status = 'pending' AND h1b_confirmed"),
        "due_followups": ("on_day INT", due_columns, f"{due} AND o.followup_day = on_day"),
        "due_followups_by_date": ("asof TIMESTAMP", due_columns,
                                  f"{due} AND j.applied_at + make_dt_interval(o.followup_day) <= asof"),
        "gap_report": ("", "company STRING, jd_url STRING, role STRING",
                       f"SELECT DISTINCT company, jd_url, role FROM {jobs} j WHERE h1b_confirmed "
                       f"AND applied_status = 'pending' AND NOT EXISTS (SELECT 1 FROM {contacts} c WHERE c.job_id = j.id)"),
        "top_scored": ("k INT, threshold INT", "rank INT, id BIGINT, role STRING, company STRING, score INT, grade STRING",
                       "SELECT rank, id, role, company, score, grade FROM (SELECT *, row_number() OVER ("
                       f"ORDER BY score DESC, id) AS rank FROM {scored} WHERE score >= threshold) WHERE rank <= k"),
    }


def register_table_functions(spark: SparkSession, jobs: str = "jobs", outreach: str = "outreach",
                             contacts: str = "contacts", scored: str = "scored") -> list[str]:
    """Create the table functions over tables or views that exist; returns their names.

    ``SELECT * FROM due_followups(7)`` is planned like the query it stands for. ``scored`` holds the
    columns id, role, company, score, grade (from ``operators.score.score_docs``).
    """
    found = table_definitions(jobs, outreach, contacts, scored)
    for name, (args, columns, query) in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE ({columns}) RETURN {query}")
    return sorted(found)
