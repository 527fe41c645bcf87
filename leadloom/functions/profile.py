"""Nested profiles as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import col


def _lines(*items: Column) -> Column:
    return F.array(*items)


def _bulleted(bullets: Column) -> Column:
    return F.transform(F.coalesce(bullets, F.array().cast("array<string>")),
                       lambda b: F.concat(F.lit("• "), b))


def profile_text(profile: Column | str) -> Column:
    """Serialise a profile struct (see ``schemas.PROFILE``), one line per item."""
    p = col(profile)
    c = p["contact"]
    head = _lines(
        c["name"],
        F.concat_ws(" | ", *[F.coalesce(c[k], F.lit(""))
                             for k in ("location", "phone", "email", "linkedin")]),
        F.lit(""), F.lit("SUMMARY"), p["summary"], F.lit(""), F.lit("SKILLS"))
    skills = F.transform(p["skills"],
                         lambda s: F.concat(s["category"], F.lit(": "), s["skills"]))
    jobs = F.flatten(F.transform(p["experience"], lambda e: F.concat(
        _lines(F.concat(F.lit("\n"), e["title"], F.lit("  |  "), e["company"], F.lit("  |  "),
                        e["start"], F.lit(" – "), e["end"])),
        _bulleted(e["bullets"]))))
    projects = F.flatten(F.transform(p["projects"], lambda e: F.concat(
        _lines(F.concat(F.lit("\n"), e["title"], F.lit("  ("),
                        F.coalesce(e["dates"], F.lit("")), F.lit(")"))),
        _bulleted(e["bullets"]))))
    none = F.array().cast("array<string>")
    project_part = F.when(F.size(F.coalesce(p["projects"], F.array().cast(
        "array<struct<title:string,dates:string,bullets:array<string>>>"))) > 0,
        F.concat(_lines(F.lit("\nPROJECTS")), projects)).otherwise(none)
    education = F.transform(p["education"], lambda e: F.concat(
        e["degree"], F.lit(" — "), e["school"], F.lit(" ("), e["date"], F.lit(")")))
    return F.array_join(F.concat(
        head, F.coalesce(skills, none), _lines(F.lit(""), F.lit("EXPERIENCE")),
        F.coalesce(jobs, none), project_part, _lines(F.lit("\nEDUCATION")),
        F.coalesce(education, none)), "\n")
