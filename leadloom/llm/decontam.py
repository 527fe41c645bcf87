"""Benchmark passages in documents: SimHash windows, Hamming blocks, exact similarity.

Texts are compared as lower-case words of letters and digits. A window has as many words as
the benchmark item it is compared with (a shorter document is one window).

1. Gate. A window similar enough shares so many shingles of five words with its item that
   some of every ``stride`` positions must hit; only windows with enough hits go on. This is
   exact: with similarity t at most (1 - t) / (1 + t) of a window's shingles are its own.
2. Fingerprint. Each window gets a 64-bit SimHash of its words.
3. Multi-index, over the distinct fingerprints. Those within ``RADIUS`` agree in one of four 16-bit blocks up to a
   quarter of it. Items are filed under every such variant of their blocks, so an equality
   join finds all pairs within the radius; the distance is then checked.
4. Proof. Exact similarity of the shingles weighted by how often they occur: sum of the
   smaller weights over sum of the larger ones.

All of it is DataFrame operations. Broadcast is only the shingle list of the benchmark, and
only if its counted rows are below ``BROADCAST_ROWS``; else the join shuffles.

Defined results: NULL and wordless texts and items match nothing; an item of fewer than five
words matches where the same words stand; repeated item rows count once, repeated document
rows each; NULL doc_ids are reported as NULL; ties between windows go to the first; empty
tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import growing, packed
from leadloom.session import freeze

WIDTH = 5
RADIUS = 15
BLOCKS = 4
BROADCAST_ROWS = 2_000_000


def words_of(col: str) -> Column:
    """Lower-case words; an empty array for NULL or no words."""
    bare = F.trim(F.regexp_replace(F.lower(F.col(col)), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, " "))


def simhash(words: str, longest: int) -> str:
    """SQL for the 64-bit SimHash of an array of words, each occurrence with weight 1.

    Bits are counted in lanes of one long, wide enough for ``longest`` words.
    """
    lane = 8 if longest < 1 << 7 else 16 if longest < 1 << 15 else 32
    ones = sum(1 << k for k in range(0, 64, lane))
    sums = (f"transform(sequence(0, {lane - 1}), k -> aggregate(transform({words}, w -> xxhash64(w)), 0L, "
            f"(a, h) -> a + (shiftrightunsigned(h, k) & {ones}L)))")
    return (f"aggregate(array({sums}), 0L, (z, s) -> aggregate(sequence(0, 63), 0L, (a, b) -> a | shiftleft("
            f"IF(2 * (shiftrightunsigned(s[b % {lane}], int(b div {lane}) * {lane}) & {(1 << lane) - 1}L) "
            f"> size({words}), 1L, 0L), b)))")


def shingles(words: str) -> str:
    """SQL for the shingles of an array of words in order; fewer words make one shingle."""
    return (f"transform(sequence(0, greatest(size({words}) - {WIDTH}, 0)), "
            f"i -> array_join(slice({words}, i + 1, {WIDTH}), ' '))")


def weighted_similarity(a: str, b: str) -> str:
    """SQL: sum of the smaller counts over sum of the larger ones of two arrays of shingles.

    Where a shingle occurs twice, its occurrences are told apart by number first.
    """
    def numbered(x: str) -> str:
        return (f"IF(size(array_distinct({x})) = size({x}), transform({x}, v -> concat('1 ', v)), "
                f"transform({x}, (v, i) -> concat(size(filter(slice({x}, 1, i + 1), u -> u = v)), ' ', v)))")
    shared = f"size(array_intersect({numbered(a)}, {numbered(b)}))"
    return f"aggregate(array({shared}), 0D, (z, n) -> n / (size({a}) + size({b}) - n))"


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, words, length of each distinct item that has words."""
    return (benchmark.select("item_id", words_of("text").alias("words")).distinct()
            .withColumn("length", F.size("words")).where("length > 0"))


def _stride(shortest: int, similarity: float) -> int:
    """How many positions apart shingles may be tried without missing a similar window."""
    own = (1 - similarity) / (1 + similarity)
    return max(1, min(int(similarity * shortest), int(1 / (2 * own)) if own else shortest))


def _gate(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, windows): windows as (length, start) that pass step 1."""
    facts = items.agg(F.min(F.when(F.col("length") >= WIDTH, F.col("length"))).alias("least"),
                      F.collect_set(F.when(F.col("length") < WIDTH, F.col("length"))).alias("short")).first()
    stride = _stride((facts["least"] or WIDTH) - WIDTH + 1, similarity)
    own = (1 - similarity) / (1 + similarity)
    index = items.select("length", F.explode(F.expr(
        f"transform(sequence(0, greatest(length - {WIDTH}, 0)), i -> xxhash64(slice(words, i + 1, {WIDTH})))"))
        .alias("h")).select("h", "length").distinct()
    index = freeze(index, "decontam-shingles")
    index = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index

    cut = docs.select("doc_id", words_of("text").alias("words"))
    tries = [F.expr(f"IF(size(words) < {WIDTH}, array(), transform(sequence(0, size(words) - {WIDTH}, {stride}), "
                    f"i -> struct(i AS pos, {WIDTH} AS width, xxhash64(slice(words, i + 1, {WIDTH})) AS h)))")]
    tries += [F.expr(f"IF(size(words) < {n}, array(), transform(sequence(0, size(words) - {n}), "
                     f"i -> struct(i AS pos, {n} AS width, xxhash64(slice(words, i + 1, {n})) AS h)))")
              for n in sorted(facts["short"])]
    tried = cut.select("doc_id", F.explode(F.concat(*tries) if len(tries) > 1 else tries[0]).alias("t"))
    hits = tried.select("doc_id", "t.*").join(index, "h").where(f"width = least(length, {WIDTH})")
    windows = hits.select("doc_id", "length", F.explode(F.expr(
        "sequence(greatest(pos - length + width, 0), pos)")).alias("start"))
    fewest = F.ceil((F.col("length") - WIDTH + 1) * similarity)
    need = F.greatest(F.floor(fewest / stride) - F.floor(fewest * own), F.lit(1))
    enough = windows.groupBy("doc_id", "length", "start").agg(F.count("*").alias("n")).where(F.col("n") >= need)
    return enough.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("length", "start")).alias("_at"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_hash, item_id, start, n_words, distance, similarity: the best window of each
    document row and item with at least ``similarity``."""
    items = freeze(benchmark_items(benchmark), "decontam-items")
    longest = items.agg(F.max("length")).first()[0] or 1
    items = items.withColumn("item_print", F.expr(simhash("words", longest)))
    places = freeze(_gate(docs, items, similarity), "decontam-windows")

    met = docs.select("doc_id", "text").join(growing(places), docs["doc_id"].eqNullSafe(places["_id"]))
    cut = met.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of("text").alias("_words"), "_at")
    window = F.explode(F.expr(
        "transform(filter(_at, x -> x.start <= greatest(size(_words) - x.length, 0)), "
        "x -> struct(x.length AS length, x.start AS start, slice(_words, x.start + 1, x.length) AS window))"))
    windows = cut.select("doc_id", "text_hash", window.alias("w")).select("doc_id", "text_hash", "w.*")
    windows = freeze(windows.withColumn("print", F.expr(simhash("window", longest))), "decontam-prints")

    bits = 64 // BLOCKS
    within = RADIUS // BLOCKS
    variants = F.filter(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda x: F.bit_count(x) <= within)
    filed = items.select("item_id", "length", "item_print",
                         F.explode(F.array(*[F.lit(b) for b in range(BLOCKS)])).alias("block"))
    filed = freeze(filed.select("*", F.explode(variants).alias("_flip")).select(
        "item_id", "length", "item_print", "block",
        F.expr(f"(shiftrightunsigned(item_print, block * {bits}) & {(1 << bits) - 1}L) ^ _flip").alias("value")),
        "decontam-index")
    asked = windows.select("length", "print").distinct().select("*", F.posexplode(F.array(*[
        F.expr(f"shiftrightunsigned(print, {b * bits}) & {(1 << bits) - 1}L") for b in range(BLOCKS)]))
        .alias("block", "value"))
    distance = F.bit_count(F.expr("print ^ item_print"))
    earlier = F.expr(f"exists(sequence(0, {BLOCKS - 1}), b -> b < block AND bit_count("
                     f"shiftrightunsigned(print ^ item_print, b * {bits}) & {(1 << bits) - 1}L) <= {within})")
    near = freeze(asked.join(filed, ["length", "block", "value"]).where((distance <= RADIUS) & ~earlier).select(
        "length", "print", "item_id", distance.alias("distance")), "decontam-near")
    proven = windows.join(near, ["length", "print"]).join(
        items.select("item_id", "length", F.col("words").alias("item_words")), ["item_id", "length"]).select(
        "doc_id", "text_hash", "item_id", "start", F.size("window").alias("n_words"), "distance",
        F.expr(shingles("window")).alias("a_"), F.expr(shingles("item_words")).alias("b_"))
    proven = proven.withColumn("similarity", F.expr(weighted_similarity("a_", "b_"))).where(
        F.col("similarity") >= similarity - 1e-12)
    best = proven.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct(
        "similarity", (-F.col("start")).alias("_first"), "n_words", "distance")).alias("b"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("b._first")).alias("start"), "b.n_words",
                       "b.distance", "b.similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, all columns unchanged."""
    found = freeze(leaks(docs, benchmark, similarity).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "decontam-found")
    return packed(docs).join(growing(found), F.col("_row.doc_id").eqNullSafe(F.col("_id"))
                             & (F.xxhash64("_row.text") == F.col("_hash")), "left_anti").select("_row.*")
