"""Contact rows from stored lookup responses (JSON text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import schemas, vocab
from leadloom.functions.classify import classify_title
from leadloom.functions.text import blank, strip_ws


def contacts_from_payload(df: DataFrame, shape: str, payload: str = "payload",
                          keep: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """One row per person with an e-mail, in payload order (``pos``).

    ``mail`` payloads hold first and last name, ``people`` payloads the full name
    and a stand-in address for locked records, which are skipped.
    """
    def text(name: str):
        return F.coalesce(F.col(f"_p.{name}"), F.lit(""))

    if shape == "mail":
        schema, people = schemas.MAIL_PAYLOAD, "_j.data.emails"
        email, title = text("value"), text("position")
        name = strip_ws(F.concat(text("first_name"), F.lit(" "), text("last_name")))
        usable = ~blank("email")
    elif shape == "people":
        schema, people = schemas.PEOPLE_PAYLOAD, "_j.people"
        email, title, name = text("email"), text("title"), text("name")
        usable = ~blank("email") & (F.col("email") != vocab.LOCKED_EMAIL)
    else:
        raise ValueError(f"unknown payload shape {shape!r}")
    parsed = df.select(*keep, F.from_json(payload, schema).alias("_j"))
    rows = parsed.select(*keep, F.posexplode(people).alias("pos", "_p"))
    return (rows.select(*keep, "pos", name.alias("name"), email.alias("email"),
                        title.alias("title"))
            .where(usable)
            .withColumn("contact_type", classify_title("title"))
            .withColumn("source", F.lit(shape)))
