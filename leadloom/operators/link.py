"""Bidirectional substring link between two name columns.

A left name is linked when, after normalisation, it contains a right name or is
contained in one. Comparing every pair is quadratic. Here both name lists are
reduced to one list of distinct names, and two equality joins follow whose right
side is unique on its key, so no bucket of names is ever paired with itself:

1. names are summarised as (anchor, lengths): the anchor is the first ``k``
   characters (the whole name if shorter), and ``lengths`` the distinct lengths of
   the left and of the right names that start with it;
2. every position of a name looks up its anchor, and only the lengths that occur
   on the other side are cut out of the name as candidates;
3. a candidate that is a name of the other side makes the link.

Work is linear in the total length of distinct names, whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions.text import norm_company
from leadloom.session import SALTS, freeze, lookup


#: Slots of the table of first letters; letters that share a slot share their anchor lengths.
LETTERS = 1024

#: starts: one row with a table of fixed size, by side and first letter the anchor lengths that occur, length g
#: as bit g - 1. anchored: the anchors that a name of the other side can have, at each of a name's positions,
#: and once the empty anchor, which stands for the empty name; a position whose letter begins no name
#: of the other side is dropped before anything is cut. candidates: pieces as long as some name with that anchor.
#: The planner knows the names only as a file, where some 300 times their size in memory fits below the limit
#: for a broadcast once they are repeated per salt; so the join that looks them up is planned as a shuffle.
_ANCHORED = """
WITH bits AS (
  SELECT is_left, pmod(ascii(name), {letters}) AS letter,
         bit_or(shiftleft(1, least(length(name), {k}) - 1)) AS bits
  FROM {names} WHERE length(name) > 0 GROUP BY ALL),
starts AS (
  SELECT transform(sequence(0, 2 * {letters} - 1), i -> coalesce(try_element_at(m, i), 0)) AS by_letter
  FROM (SELECT map_from_entries(collect_list(struct(cast(is_left AS INT) * {letters} + letter, bits))) AS m FROM bits)),
steps AS (
  SELECT name, is_left, NOT is_left AS other, explode(sequence(1, length(name))) AS at
  FROM {names} WHERE length(name) > 0),
found AS (
  SELECT *, get((SELECT by_letter FROM starts),
                cast(other AS INT) * {letters} + pmod(ascii(substring(name, at, 1)), {letters})) AS bits
  FROM steps),
anchored AS (
  SELECT name, is_left, other, at, substring(name, at, g) AS anchor
  FROM (SELECT *, explode(get({lengths_of_bits}, bits)) AS g FROM found WHERE bits <> 0)
  WHERE at + g - 1 <= length(name)
  UNION ALL SELECT name, is_left, NOT is_left, 1, '' FROM {names})"""

_LINKED = _ANCHORED + """,
lengths AS (
  SELECT substring(name, 1, {k}) AS anchor, is_left AS other, collect_set(length(name)) AS lengths
  FROM {names} GROUP BY ALL),
spread AS (SELECT *, explode(sequence(0, {salts} - 1)) AS salt FROM lengths),
candidates AS (
  SELECT name AS long, is_left AS long_left, other AS is_left, substring(name, at, n) AS name,
         pmod(xxhash64(name), {salts}) AS salt
  FROM (SELECT a.*, explode(l.lengths) AS n FROM (SELECT *, pmod(xxhash64(name, at), {salts}) AS salt FROM anchored) a
        JOIN spread l ON a.anchor = l.anchor AND a.other = l.other AND a.salt = l.salt)
  WHERE at + n - 1 <= length(name))
SELECT /*+ MERGE(t) */ DISTINCT if(long_left, long, c.name) AS name
FROM candidates c LEFT SEMI JOIN (SELECT *, explode(sequence(0, {salts} - 1)) AS salt FROM {names}) t
  ON c.name = t.name AND c.is_left = t.is_left AND c.salt = t.salt
"""


def _run(query: str, names: DataFrame, k: int, salts: int) -> DataFrame:
    """One statement is analysed once; a chain of a dozen DataFrame calls is analysed at every call."""
    table = ", ".join(f"array({', '.join(str(g + 1) for g in range(k) if bits >> g & 1)})" for bits in range(1, 1 << k))
    query = query.replace("{lengths_of_bits}", f"array(cast(array() AS ARRAY<INT>), {table})")
    return names.sparkSession.sql(query, names=names, k=k, salts=salts, letters=LETTERS)


def anchored(names: DataFrame, k: int = 4) -> DataFrame:
    """name, is_left, other, at, anchor: what is looked up for ``names`` (name, is_left)."""
    return _run(_ANCHORED + " SELECT * FROM anchored", names, k, SALTS)


def linked_names(names: DataFrame, k: int = 4, salts: int = SALTS) -> DataFrame:
    """The left names that contain, or are contained in, a right name.

    ``names`` has distinct rows (name, is_left). Right sides are repeated per salt, so a very common
    anchor or piece is spread over ``salts`` tasks.
    """
    return _run(_LINKED, names, k, salts)


def substring_link(left: DataFrame, right: DataFrame, left_col: str, right_col: str,
                   k: int = 4, mode: str = "faithful", min_len: int = 0,
                   removals: tuple[str, ...] = vocab.COMPANY_REMOVALS,
                   flag: str = "h1b_confirmed", spread: list[str] | None = None,
                   salts: int = SALTS) -> DataFrame:
    """All left rows with a flag that says whether the name is linked.

    An empty name is part of every name; ``min_len=1`` keeps empty names out.
    ``spread`` names columns that tell the rows of one company apart; with it a
    very common company is spread over several tasks.
    """
    norm = norm_company(left_col, removals, mode)
    marked = left.withColumn("_norm", F.coalesce(norm, F.lit("")))
    ours = marked.select(F.col("_norm").alias("name"), F.lit(True).alias("is_left"))
    theirs = right.select(norm_company(right_col, removals, mode).alias("name"),
                          F.lit(False).alias("is_left"))
    names = ours.unionByName(theirs).where(
        F.col("name").isNotNull() & (F.length("name") >= min_len)).distinct()
    # used three times below: written once, so the big tables are not scanned again
    hits = linked_names(freeze(names, "names"), k, salts).select(
        F.col("name").alias("_norm"), F.lit(True).alias("_hit"))
    joined = lookup(marked, hits, ["_norm"], "left", spread, salts)
    columns = [c for c in left.columns if c != flag]
    return joined.select(*columns, F.coalesce("_hit", F.lit(False)).alias(flag))


def tag_linked(jobs: DataFrame, sponsors: DataFrame, company: str = "company",
               name: str = "name", k: int = 4, flag: str = "h1b_confirmed",
               spread: list[str] | None = None) -> DataFrame:
    """Set the flag on linked rows; rows whose flag is already set are not linked again."""
    is_set = F.coalesce(F.col(flag), F.lit(False))
    linked = substring_link(jobs.where(~is_set).withColumnRenamed(flag, "_old"), sponsors, company, name, k,
                            removals=vocab.SPONSOR_REMOVALS, flag="_new", spread=spread)
    tagged = linked.withColumn(flag, F.col("_old") | F.col("_new")).select(*jobs.columns)
    return jobs.where(is_set).unionByName(tagged)


def sponsor_set(companies: DataFrame) -> DataFrame:
    """Distinct lower-cased names of confirmed sponsors."""
    return companies.where("h1b_confirmed").select(F.lower("name").alias("name")).distinct()
