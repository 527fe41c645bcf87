"""Text and URL functions. All stay in the JVM; none is a Python UDF."""

from __future__ import annotations

from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import vocab

# What Python's str.strip() removes.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
              "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def blank(c: Column | str) -> Column:
    """True for NULL and for the empty string."""
    return F.coalesce(col(c), F.lit("")) == ""


def remove_all(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda acc, part: F.replace(acc, F.lit(part), F.lit("")), parts, c)


def norm_company(c: Column | str, removals: tuple[str, ...] = vocab.COMPANY_REMOVALS,
                 suffix_mode: str = "faithful") -> Column:
    """Lower-case a company name and drop legal suffixes.

    ``faithful`` removes each part anywhere and in order ("Acme Corporation"
    becomes ``acmeoration``). ``word_boundary`` removes a suffix only as a word.
    """
    low = F.lower(col(c))
    if suffix_mode == "faithful":
        return strip_ws(remove_all(low, removals))
    if suffix_mode != "word_boundary":
        raise ValueError(f"unknown suffix_mode {suffix_mode!r}")
    words = "|".join(p.strip().rstrip(".") for p in sorted(removals, key=len, reverse=True)
                     if p.startswith(" "))
    no_suffix = F.regexp_replace(low, rf"\s(?:{words})(?![\p{{L}}\p{{N}}_])", "")
    return strip_ws(remove_all(no_suffix, tuple(p for p in removals if len(p) == 1)))


def domain_guess(c: Column | str) -> Column:
    return F.concat(remove_all(F.lower(col(c)), vocab.DOMAIN_REMOVALS), F.lit(".com"))


def url_host(c: Column | str) -> Column:
    """Host of a URL whose scheme may be missing, without any ``www.``."""
    url = F.when(F.contains(col(c), F.lit("://")), col(c)).otherwise(
        F.concat(F.lit("https://"), col(c)))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#]*)", 1)
    host = F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)", 1)) \
        .otherwise(F.substring_index(authority, ":", 1))
    return F.replace(F.lower(host), F.lit("www."), F.lit(""))


def url_canonical(c: Column | str) -> Column:
    return F.substring_index(col(c), "?", 1)


def url_join(base: str, href: Column | str) -> Column:
    """Resolve a link against a fixed base URL (dot segments are kept)."""
    parts = urlsplit(base)
    root = f"{parts.scheme}://{parts.netloc}"
    folder = root + (parts.path.rpartition("/")[0] or "") + "/"
    h = col(href)
    return (F.when(blank(h), F.lit(base))
            .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(F.lit(parts.scheme + ":"), h))
            .when(h.startswith("/"), F.concat(F.lit(root), h))
            .when(h.startswith("?"), F.concat(F.lit(root + parts.path), h))
            .when(h.startswith("#"), F.concat(F.lit(base.partition("#")[0]), h))
            .otherwise(F.concat(F.lit(folder), h)))


def view_url(prefix: str, item: Column | str) -> Column:
    """``prefix`` + id, or '' when there is no id."""
    return F.when(blank(item), F.lit("")).otherwise(F.concat(F.lit(prefix), col(item)))


def digits_to_int(c: Column | str) -> Column:
    digits = F.regexp_replace(col(c), "[^0-9]", "")
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def norm_text(c: Column | str) -> Column:
    spaced = F.replace(F.lower(col(c)), F.lit("-"), F.lit(" "))
    return F.replace(spaced, F.lit("_"), F.lit(" "))


def quantity_mentions(c: Column | str,
                      patterns: tuple[str, ...] = vocab.QUANTITY_PATTERNS) -> Column:
    """Number of quantity mentions; one mention may count under two patterns."""
    return reduce(lambda a, b: a + b,
                  [F.regexp_count(col(c), F.lit("(?i)" + p)) for p in patterns])


def safe_name(c: Column | str, n: int = 25, strip: bool = True) -> Column:
    text = strip_ws(c) if strip else col(c)
    return F.substring(F.regexp_replace(text, r"[^\p{L}\p{N}_\-]", "_"), 1, n)


def preview(c: Column | str, n: int) -> Column:
    return F.substring(F.coalesce(col(c), F.lit("")), 1, n)


def default_text(description: Column | str, role: Column | str, company: Column | str) -> Column:
    """The description, or a one-line stand-in when it is NULL or empty."""
    stand_in = F.concat(F.lit("Role: "), col(role), F.lit(" at "), col(company))
    return F.coalesce(F.nullif(col(description), F.lit("")), stand_in)


def yes_no(c: Column | str) -> Column:
    return F.when(col(c), F.lit("Yes")).otherwise(F.lit("No"))


def first_name(c: Column | str) -> Column:
    name = col(c)
    word = F.regexp_extract(strip_ws(name), r"^\S+", 0)
    return F.when(blank(word) | (name == vocab.PLACEHOLDER_CONTACT), F.lit("there")) \
        .otherwise(word)


def template_no(c: Column | str, templates: int = 3) -> Column:
    return F.pmod(F.coalesce(col(c), F.lit(1)), F.lit(templates)) + 1


def title_label(c: Column | str) -> Column:
    """snake_case to a label; a letter is upper-cased after any non-letter."""
    spaced = F.replace(col(c), F.lit("_"), F.lit(" "))
    runs = F.split(spaced, r"(?<=\P{L})(?=\p{L})", -1)
    return F.array_join(F.transform(runs, F.initcap), "")


def date_label(c: Column | str, pattern: str = "EEEE, MMMM dd") -> Column:
    return F.date_format(col(c), pattern)


def first_date(*stamps: Column | str) -> Column:
    """First ten characters of the first non-empty timestamp text."""
    filled = F.coalesce(*[F.nullif(col(s).cast("string"), F.lit("")) for s in stamps], F.lit(""))
    return F.substring(filled, 1, 10)


def strip_markup(c: Column | str, chars: str = vocab.DIGEST_MARKUP) -> Column:
    return remove_all(col(c), tuple(chars))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def is_contaminated(c: Column | str, markers: tuple[str, ...] = vocab.DRAFT_MARKERS) -> Column:
    """Empty text, or text that holds a marker in any letter case.

    The one-element array makes Spark lower-case the text once. As plain ORs in a
    filter it would be lower-cased again for every marker.
    """
    words = tuple(m.lower() for m in markers)
    found = F.exists(F.array(F.lower(col(c))), lambda low: contains_any(low, words))
    return blank(c) | F.coalesce(found, F.lit(False))


def repaired_subject(c: Column | str) -> Column:
    return F.when(col(c).startswith("] "), strip_ws(F.ltrim(col(c), F.lit("] ")))) \
        .otherwise(col(c))


def parse_labelled(c: Column | str) -> Column:
    """Split generated text into ``subject`` and ``body``.

    Labels are looked for only if "[subject" occurs anywhere or the text starts
    with "subject:"; otherwise everything is body. A closing note block that
    starts with a ``---`` line and a ``*`` is cut off.
    """
    raw = col(c)
    low = F.lower(raw)
    labelled = F.contains(low, F.lit("[subject")) | low.startswith("subject:")
    lines = F.split(raw, "\n", -1)
    trimmed = F.transform(lines, strip_ws)

    def first_at(pattern: str) -> Column:
        return F.array_position(F.transform(trimmed, lambda t: t.rlike(pattern)), True)

    subject_at = first_at(r"(?i)^\[?subject[:\]]+")
    body_at = first_at(r"(?i)^\[?body[:\]]+")
    line = F.regexp_replace(F.get(trimmed, (subject_at - 1).cast("int")),
                            r"(?i)^\[?subject[:\]]+\s*\]?\s*", "")
    subject = F.when(labelled & (subject_at > 0), strip_ws(F.ltrim(line, F.lit("]")))) \
        .otherwise(F.lit(""))

    def after(position: Column) -> Column:
        return F.array_join(F.slice(lines, (position + 1).cast("int"), F.size(lines)), "\n")

    body = (F.when(labelled & (body_at > 0), strip_ws(after(body_at)))
            .when(labelled & (subject_at > 0), strip_ws(after(subject_at)))
            .otherwise(raw))
    return F.struct(subject.alias("subject"), strip_ws(strip_note(body)).alias("body"))


def strip_note(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?s)\n---\n\*.*$", "")


def extract_bullets(c: Column | str) -> Column:
    """Bulleted lines (-, • or –) longer than ten characters, without the mark."""
    lines = F.split(col(c), LINE_BREAK, -1)
    kept = F.filter(lines, lambda ln: strip_ws(ln).rlike(r"^[-•–]")
                    & (F.length(strip_ws(ln)) > 10))
    return F.transform(kept, lambda ln: strip_ws(F.ltrim(ln, F.lit("•-– "))))


def link_scan(html: Column | str, fallback: Column | str,
              hosts: tuple[str, ...] = vocab.LINK_HOSTS) -> Column:
    """First link to one of ``hosts`` (in host order), else the fallback URL."""
    found = []
    for host in hosts:
        pattern = r"https?://[^\s\"'<>]+" + host.replace(".", r"\.") + r"[^\s\"'<>]*"
        # the substring test is far cheaper than the regular expression
        found.append(F.when(F.contains(col(html), F.lit(host)),
                            F.nullif(F.regexp_extract(col(html), pattern, 0), F.lit(""))))
    return F.coalesce(*found, col(fallback))


def route_url(c: Column | str) -> Column:
    """Split off the direct-apply prefix and build the ``/apply`` form."""
    url = col(c)
    direct = url.startswith(vocab.DIRECT_APPLY_PREFIX)
    target = F.when(direct, F.substring(url, len(vocab.DIRECT_APPLY_PREFIX) + 1, 1 << 30)) \
        .otherwise(url)
    return F.struct(direct.alias("direct"), target.alias("url"),
                    F.concat(F.rtrim(target, F.lit("/")), F.lit("/apply")).alias("apply_url"))
