"""Which of many fixed words are in a text, without one pass over the text for every word.

One regular expression passes over the text and lists the *hooks* in it: the ends of words from their first
character on that is not common in prose. Only words whose hook is listed are then searched for in the text, so the
result is that of ``contains`` for every word. Which characters are taken as common decides about time only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of prose, the most frequent first; all others count as rare.
BY_FREQUENCY = " etaoinsrhldcumpgfywbvkxjqz"
COMMON = BY_FREQUENCY[:11]


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once, whatever fn does with it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def hook(word: str) -> str | None:
    """The end of ``word`` from its first character on that is not common, two characters at least.

    None if there is no such end: the word is searched for directly.
    """
    return next((word[i:] for i in range(len(word) - 1) if word[i] not in COMMON), None)


def _any_of(tails: Iterable[str]) -> str:
    """An expression for the longest of ``tails`` that begins here.

    Alternatives share no first character, so their order is free: frequent characters are tried first.
    """
    by_first: dict[str, set[str]] = {}
    for tail in sorted(tails, key=lambda tail: (BY_FREQUENCY.find(tail[:1]) % 99, tail)):
        by_first.setdefault(tail[:1], set()).add(tail[1:])
    may_end = by_first.pop("", None) is not None
    rest = "|".join(re.escape(first) + _any_of(after) for first, after in by_first.items())
    if may_end:
        return f"(?:{rest})?" if rest else ""
    return rest if len(by_first) == 1 else f"(?:{rest})"


def hook_pattern(hooks: Iterable[str]) -> str:
    """Matches one character where a hook begins; its first group is the longest hook there.

    The plain class in front passes over most of a text quickly. Hooks may overlap: only their first character is consumed.
    """
    hooks = set(hooks)
    first = "".join(re.escape(c) for c in sorted({h[0] for h in hooks}))
    return rf"[{first}](?<=(?=({_any_of(hooks)}))[\s\S])"


def with_search(text: Column, words: Iterable[str], fn: Callable[[Callable[[str], Column]], Column]) -> Column:
    """``fn(has)``, where ``has(word)`` tells whether one of ``words`` is a substring of the text."""
    hooks = {w: h for w in words if (h := hook(w))}

    def searched(found: Column) -> Callable[[str], Column]:
        def has(word: str) -> Column:
            there = F.contains(text, F.lit(word))
            if word not in hooks:
                return there
            listed = sorted({h for h in hooks.values() if h.startswith(hooks[word])})
            return reduce(lambda a, b: a | b, [F.array_contains(found, h) for h in listed]) & there
        return has

    if not hooks:
        return fn(lambda word: F.contains(text, F.lit(word)))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(hook_pattern(hooks.values())), F.lit(1)))
    return let(found, lambda seen: fn(searched(seen)))
