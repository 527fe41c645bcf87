"""Ordered first-match classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions.text import col, contains_any, strip_ws


def first_match(c: Column | str, classes: tuple[tuple[str, tuple[str, ...]], ...],
                default: str) -> Column:
    """Label of the first class one of whose keywords is a substring.

    The one-element array lower-cases the text once, also inside a filter, where
    Spark would evaluate it again for every keyword.
    """
    def label_of(low: Column) -> Column:
        (label, words), *rest = classes
        out = F.when(contains_any(low, words), F.lit(label))
        for label, words in rest:
            out = out.when(contains_any(low, words), F.lit(label))
        return out.otherwise(F.lit(default))

    low = F.coalesce(F.lower(col(c)), F.lit(""))
    return F.get(F.transform(F.array(low), label_of), F.lit(0))


def classify_title(c: Column | str) -> Column:
    return first_match(c, vocab.CONTACT_CLASSES, "other")


def classify_role(c: Column | str) -> Column:
    return first_match(strip_ws(c), vocab.ROLE_VARIANTS, vocab.ROLE_DEFAULT)


def classify_url(c: Column | str) -> Column:
    return first_match(c, vocab.PLATFORMS, "unknown")


def classify_message(c: Column | str) -> Column:
    return first_match(c, vocab.SERVICE_ERRORS, "other")
