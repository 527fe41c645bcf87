"""Mixing sources to target weights by weighted fair queueing.

Every document, in shuffled order within its source, gets the virtual time at which a fair
queue would have served it: the words of its source so far divided by the source's weight.
A source may be served ``limit`` times over. All passes are range-sorted by virtual time and
cut where the words reach the budget. A source that runs dry leaves its share to the
others by weight, because the queue then moves on faster for them.

The shuffle orders documents by md5 of seed and id, so SQL engines can repeat it.

Defined results: NULL sources are one source, ordered last; NULL or empty text has size 0
and takes 0; repeated rows are documents of their own; ties in virtual time are ordered by
source, pass and place in the source; no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import WORD, packed, running_totals
from leadloom.session import freeze


def _size(col: str) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, cycle: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) with ``weight``: the cycle dealt out in code-point order, NULL last."""
    ranked = running_totals(sources, [F.col("source").asc_nulls_last()],
                            {"_rank": F.lit(1).cast("long"), "_upto": "source_size"}, "mix-sources")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return ranked.select("source", "source_size", (F.col("_upto") - F.col("source_size")).alias("_before"),
                         F.get(weights, ((F.col("_rank") - 1) % len(cycle)).cast("int")).alias("weight"))


def targets(sources: DataFrame, share: float = 1.0, limit: int = 3) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): shares by weight, at most ``limit`` sizes.

    The water level at which all targets add up to the budget decides: a source is capped
    if, at the level that just fills it, the budget is not yet used up. Running sums over
    the sources, ordered by that level, give the answer without repeated rounds.
    """
    cap = F.col("source_size") * F.lit(float(limit))
    whole = freeze(sources, "mix-weights")
    sums = whole.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    budget, weight = float(sums["n"] or 0) * share, sums["w"] or 0.0
    filled = running_totals(whole.withColumn("_level", cap / F.col("weight")),
                            [F.col("_level").asc(), F.col("source").asc_nulls_last()],
                            {"_caps": cap, "_weights": F.col("weight")}, "mix-levels")
    used = F.col("_caps") + F.col("_level") * (F.lit(weight) - F.col("_weights"))
    marked = freeze(filled.withColumn("_capped", used < F.lit(budget)).drop("_caps", "_weights"), "mix-capped")
    rest = marked.agg(F.sum(F.when(F.col("_capped"), cap).otherwise(0.0)).alias("caps"),
                      F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("weight"))).alias("w")).first()
    level = (budget - (rest["caps"] or 0.0)) / rest["w"] if rest["w"] else 0.0
    return marked.withColumn("target", F.when(F.col("_capped"), cap).otherwise(
        F.least(cap, F.col("weight") * F.lit(level)))).drop("_capped", "_level")


def mix(docs: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), share: float = 1.0,
        limit: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, weight, target, copies, taken: one row per row of ``docs``."""
    narrow = freeze(docs.select(
        "doc_id", "source", _size("text").alias("size")), "mix-rows")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = freeze(targets(cycle_weights(sizes, cycle), share, limit), "mix-targets")
    budget = int((sources.agg(F.sum("source_size")).first()[0] or 0) * share)
    shuffled = narrow.withColumn("_shuffle", F.md5(F.concat(F.lit(str(seed)), F.col("doc_id").cast("string"))))
    order = [F.col("source").asc_nulls_last(), F.col("_shuffle"), F.col("doc_id"), F.col("size")]
    queued = running_totals(shuffled, order, {"_upto": "size", "_pos": F.lit(1).cast("long")}, "mix-queue")
    served = freeze(
        queued.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s", "_shuffle"), "mix-served")
    finish = ((F.col("_pass") * F.col("source_size") + F.col("_upto") - F.col("_before"))
              / F.col("weight"))
    passes = (served.where("size > 0").select("_pos", "size", "source_size", "weight", "_upto", "_before",
                                              F.explode(F.sequence(F.lit(0), F.lit(limit - 1))).alias("_pass"))
              .select("_pos", "size", "_pass", finish.alias("_finish")))
    line = running_totals(passes, [F.col("_finish"), F.col("_pos"), F.col("_pass")],
                          {"_words": "size"}, "mix-line")
    taken = line.where(F.col("_words") <= F.lit(budget)).groupBy("_pos").agg(F.count("*").alias("copies"))
    copies = F.coalesce("copies", F.lit(0))
    return served.join(taken, "_pos", "left").select(
        "doc_id", "source", "size", "source_size", "weight", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The documents of the mix, each as often as it was taken, with all columns of ``docs``.

    Copies are counted per (doc_id, source, size); rows equal in these share them evenly and
    one of them stands for what is left over, so no group of equal rows meets in one task.
    """
    keys = ["_id", "_source", "_size"]
    plan = mix(docs, **kw).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                                   F.col("size").alias("_size")).agg(
        F.sum("copies").alias("_all"), F.count("*").alias("_rows"))
    plan = freeze(plan.where("_all > 0").withColumns(
        {"_each": F.expr("_all div _rows"), "_left": F.expr("_all % _rows")}), "mix-plan")
    rows = packed(docs).withColumn("_words", _size("_row.text"))
    same = (F.col("_row.doc_id").eqNullSafe(F.col("_id")) & F.col("_row.source").eqNullSafe(F.col("_source"))
            & (F.col("_words") == F.col("_size")))

    def times(rows: DataFrame, n: str) -> DataFrame:
        return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(n)))).select("_row.*")

    even = times(rows.join(plan.where("_each > 0"), same), "_each")
    spare = rows.join(plan.where("_left > 0"), same).dropDuplicates(keys)
    return even.unionByName(times(spare, "_left"))
