"""Rendered text: prompts, follow-ups, drafts and list lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import col, first_name


def render_template(template: str, slots: dict[str, Column],
                    limits: dict[str, int] | None = None) -> Column:
    """Fill ``{slot}`` marks; a slot in ``limits`` is cut to that many characters."""
    limits = limits or {}
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
            continue
        value = F.coalesce(slots[piece].cast("string"), F.lit(""))
        parts.append(F.substring(value, 1, limits[piece]) if piece in limits else value)
    return F.concat(*parts)


@dataclass(frozen=True)
class PromptTemplate:
    """Prompt text with ``{slot}`` marks and the length limit of long slots."""

    text: str
    limits: dict[str, int] = field(default_factory=dict)


PROMPTS = {
    "bullets": PromptTemplate(
        "Rewrite the profile bullets below for this listing. Keep their grouping, use only "
        "facts found in the profile, and end with a section GAPS TO ADDRESS.\n\n"
        "Listing:\n{description}\n\nProfile:\n{profile}\n"),
    "letter": PromptTemplate(
        "Write a cover letter of three to four paragraphs for {role} at {company}, "
        "signed by {sender}.\n\nListing:\n{description}\n\nProfile:\n{profile}\n",
        {"profile": 3000}),
    "email_1": PromptTemplate(
        "Write a four-line note from {sender} to {first_name} ({title}) at {company} about "
        "{role}: one observation, one question, one result, one invitation. Start with a "
        "line 'subject: ...'.\n\nProfile:\n{profile}\n\nListing:\n{description}\n",
        {"profile": 2000, "description": 600}),
    "email_2": PromptTemplate(
        "Write a six-line note from {sender} to {first_name} ({title}) at {company} about "
        "{role}: two problems of the team, then two results that answer them. Start with a "
        "line 'subject: ...'.\n\nProfile:\n{profile}\n\nListing:\n{description}\n",
        {"profile": 2000, "description": 600}),
    "email_3": PromptTemplate(
        "Write a four-line note from {sender} to {first_name} ({title}) at {company} about "
        "{role}: one trigger, one priority, one comparable result. Start with a "
        "line 'subject: ...'.\n\nProfile:\n{profile}\n\nListing:\n{description}\n",
        {"profile": 2000, "description": 600}),
    "referral": PromptTemplate(
        "Write a message of at most four sentences from {sender} to {name} ({title} at "
        "{company}) that asks for a referral for {role}.\n\nProfile:\n{profile}\n",
        {"profile": 1200}),
}


def render_prompt(kind: str, slots: dict[str, Column]) -> Column:
    template = PROMPTS[kind]
    return render_template(template.text, slots, template.limits)


def slot_limit(slot: str, *kinds: str) -> int | None:
    """Characters of a slot that some of these prompts can show; None if one shows all of it."""
    limits = [PROMPTS[k].limits.get(slot) for k in kinds]
    return None if None in limits else max(limits)


def cut(value: Column, limit: int | None) -> Column:
    return value if limit is None else F.substring(value, 1, limit)


def email_prompt(number: Column, slots: dict[str, Column]) -> Column:
    """The e-mail prompt for template 1, 2 or (anything else) 3."""
    full = {**slots, "first_name": first_name(slots["name"])}
    return (F.when(number == 1, render_prompt("email_1", full))
            .when(number == 2, render_prompt("email_2", full))
            .otherwise(render_prompt("email_3", full)))


FOLLOWUP_SUBJECT = "Following up — {role} application at {company}"
FOLLOWUP_BODIES = {
    3: "Hello,\n\nA few days ago I applied for the {role} position at {company}. I would be glad "
       "to tell you more or to send anything that is missing.\n\nRegards,\n{sender}\n",
    7: "Hello,\n\nA week ago I applied for the {role} position at {company}. If it is still open, "
       "I would welcome a short call.\n\nRegards,\n{sender}\n",
    None: "Hello,\n\nThis is my last note on the {role} position at {company}. Thank you for "
          "reading; feedback is welcome.\n\nRegards,\n{sender}\n",
}


def render_followup(company: Column | str, role: Column | str, day: Column | str,
                    sender: str) -> Column:
    slots = {"company": col(company), "role": col(role), "sender": F.lit(sender)}
    out = None
    for number, text in FOLLOWUP_BODIES.items():
        body = render_template(text, slots)
        if number is None:
            out = out.otherwise(body)
        else:
            out = (F if out is None else out).when(col(day) == number, body)
    return F.struct(render_template(FOLLOWUP_SUBJECT, slots).alias("subject"),
                    out.alias("body"))


def draft_file_name(outreach_type: Column | str, followup_day: Column | str,
                    contact_type: Column | str, row_id: Column | str) -> Column:
    """File name of a draft. A missing contact shows as ``None``."""
    kind, day = col(outreach_type), col(followup_day)
    ctype = F.coalesce(col(contact_type), F.lit("None"))
    return (F.when(kind == "cold_email", F.concat(F.lit("cold_email_"), ctype, F.lit(".txt")))
            .when((kind == "followup") & (F.coalesce(day, F.lit(0)) != 0),
                  F.concat(F.lit("followup_day"), day.cast("string"), F.lit(".txt")))
            .otherwise(F.concat(kind, F.lit("_"), col(row_id).cast("string"), F.lit(".txt"))))


# Fixed value: the layout of a draft document.
DRAFT_LAYOUT = ("TO: {email}\nCONTACT: {name} ({title})\nSUBJECT: {subject}\n"
                "STATUS: {status}\n" + "=" * 60 + "\n\n{body}")


def draft_content(email: Column, name: Column, title: Column, subject: Column, status: Column,
                  body: Column) -> Column:
    def shown(c: Column) -> Column:
        return F.coalesce(c, F.lit("None"))

    return render_template(DRAFT_LAYOUT, {
        "email": shown(email), "name": shown(name), "title": shown(title),
        "subject": shown(subject), "status": shown(status), "body": shown(body)})


def cut_pad(c: Column, cut: int, width: int) -> Column:
    """At most ``cut`` characters, padded on the right to ``width``."""
    return F.rpad(F.substring(c, 1, cut), width, " ")


def list_line(rank: Column, score: Column, grade: Column, role: Column, company: Column,
              missing: Column) -> Column:
    """One line of a ranked list: padded fields and the first three gaps."""
    gaps = F.array_join(F.slice(missing, 1, 3), ", ")
    return F.concat(
        F.lpad(rank.cast("string"), 3, " "), F.lit(".  "),
        F.lpad(score.cast("string"), 3, " "), F.lit("/100  ("), grade, F.lit(")  "),
        cut_pad(role, 35, 36), F.lit(" "), cut_pad(company, 20, 22), F.lit(" "),
        F.when(gaps == "", F.lit("—")).otherwise(gaps))
