"""Near-duplicates by min-max hashing.

Each permutation of the 64-bit shingle hashes gives two signature values, its minimum and
its maximum, so a signature of n values costs n/2 hash evaluations. Values are banded;
texts that share a band are candidates, and every link is confirmed on the full sets.

* Texts with the same set become one node first, so copies never meet in a bucket.
* In a bucket each node is compared with one of them, its head (as many pairs as nodes); in
  larger buckets the head is drawn by hash, so a node of a large group meets many others over
  its buckets. What is then linked is one component.
* What is left are pairs of one bucket in different components. A node outside the bucket's
  largest component is compared with that whole component, and those outside it with each other, all
  in one pass block by block: a block holds at most ``BLOCK`` texts and about ``SHINGLES`` shingles, unless a
  single text has more, and neither pairs nor groups are listed. Every candidate is decided exactly; none is dropped.
* Links found there join components, so the last step works on roots only.
* Chance of missing a link at similarity 0.8 with 32 bands of 6 values: 6e-5 for large sets, less
  above. Minimum and maximum of one permutation agree together with i(i-1)/(u(u-1)) for i common
  of u shingles, so small sets miss more: 4.2e-4 at 4 of 5, 1.5e-4 at 8 of 10.

Defined results: NULL text and text without words have an empty set, are linked with
nothing and are their own component; fewer words than a shingle needs make one shingle;
repeated rows share a component; a row without doc_id joins the component of its equals
and is not kept if one of those has an id; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm import textbuf
from leadloom.llm.common import components, growing, packed
from leadloom.session import freeze, lookup

BANDS, ROWS = 32, 6
BLOCK, SHINGLES = 64, 1 << 16
SMALL = 8
_SEED = 0x5DEECE66D


def _factors(n: int) -> np.ndarray:
    """Odd multipliers: each permutes the 64-bit numbers."""
    return textbuf.mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(_SEED)) | np.uint64(1)


def band_keys(h: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of band keys per text with shingles, from the min and max of each permutation."""
    some = begin[:-1][np.diff(begin) > 0]
    keys = np.empty((len(some), bands), dtype=np.uint64)
    if not len(some):
        return keys
    acc = np.zeros(len(some), dtype=np.uint64)
    value = 0
    for factor in _factors(-(-bands * rows // 2)):
        moved = h * factor
        for extreme in (np.minimum, np.maximum):
            if value == bands * rows:
                break
            if value % rows == 0:
                acc = np.full(len(some), value // rows, dtype=np.uint64)
            acc = textbuf.mix(acc * np.uint64(0x9E3779B97F4A7C15) + extreme.reduceat(moved, some))
            value += 1
            if value % rows == 0:
                keys[:, value // rows - 1] = acc
    return keys


def _shingles(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in textbuf.chunks(texts):
        data = textbuf.lower(data)
        start, stop, begin = textbuf.words(data, offsets)
        h, at = textbuf.shingle_hashes(textbuf.word_hashes(data, start, stop), begin, width)
        yield first, end, *textbuf.distinct(h, at)


def _marks(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit marks of each set (sum and xor of different mixes); 0 for an empty one."""
    out = np.zeros((2, len(begin) - 1), dtype=np.uint64)
    has = np.diff(begin) > 0
    if has.any():
        at = begin[:-1][has]
        out[0, has] = np.add.reduceat(textbuf.mix(h + np.uint64(1)), at)
        out[1, has] = np.bitwise_xor.reduceat(textbuf.mix(h ^ np.uint64(_SEED)), at)
    return out[0], out[1]


def _long_lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, two marks of the set, band keys (none without shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbuf.hold("near dedup")
        for batch in batches:
            ids = batch.column(0)
            for first, end, h, begin in _shingles(batch.column(1), width):
                keys = band_keys(h, begin, bands, rows)
                many = np.where(np.diff(begin) > 0, bands, 0)
                at = np.concatenate([[0], np.cumsum(many)])
                one, two = _marks(h, begin)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), batch.column(2).slice(first, end - first),
                     pa.array(np.diff(begin).astype(np.int64)), pa.array(one.view(np.int64)),
                     pa.array(two.view(np.int64)), _long_lists(keys.reshape(-1), at)],
                    ["doc_id", "text_hash", "n_shingles", "mark1", "mark2", "bands"])
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, mark1 long, mark2 long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark1, shingles: the full set of each text as sorted hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbuf.hold("near dedup")
        for batch in batches:
            ids = batch.column(0)
            for first, end, h, begin in _shingles(batch.column(1), width):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), pa.array(_marks(h, begin)[0].view(np.int64)),
                     _long_lists(h, begin)], ["doc_id", "mark1", "shingles"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, mark1 long, shingles array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``shared`` and ``total`` (sizes of intersection and union) to pairs (a, b, ...)."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("_sa", "_sb")).cast("long")
    return both.withColumn("shared", shared).withColumn(
        "total", F.size("_sa") + F.size("_sb") - F.col("shared")).drop("_sa", "_sb")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80,
                bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash: one row per row of ``docs``."""
    sig = freeze(signatures(docs, width, bands, rows), "near-signatures")
    same = ["mark1", "mark2", "n_shingles"]
    reps = freeze(sig.where("n_shingles > 0").groupBy(*same).agg(
        F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "near-sets")
    node = F.struct(F.col("rep").alias("id"), F.col("mark1").alias("mark"), F.col("n_shingles").alias("n"))
    entries = reps.where("rep IS NOT NULL").select(node.alias("node"), F.explode("bands").alias("key"))
    drawn = F.xxhash64("key", "node")
    heads = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"),
                                       F.min(F.struct(drawn.alias("draw"), "node")).alias("any")).where("n > 1")
    head = F.when(F.col("n") <= SMALL, F.col("least")).otherwise(F.col("any.node"))
    buckets = freeze(entries.join(heads.select("key", head.alias("head")), "key"), "near-buckets")

    linked = F.col("shared") * 100 >= F.col("total") * percent
    star = buckets.where("node <> head").select(F.least("head", "node").alias("a"),
                                                F.greatest("head", "node").alias("b")).distinct()
    star = freeze(star, "near-star")
    wanted = star.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = freeze(wanted.select("node", F.col("node.id").alias("_id"), F.col("node.mark").alias("_mark")),
                    "near-wanted")
    ids = wanted.select("_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(
        growing(ids), F.col("doc_id") == F.col("_id"), "left_semi")
    sets = shingle_sets(texts, width)
    sets = freeze(sets.join(wanted, (sets["doc_id"] == wanted["_id"]) & (sets["mark1"] == wanted["_mark"]))
                  .groupBy("node").agg(F.any_value("shingles").alias("shingles")), "near-full-sets")
    checked = freeze(_confirm(star, sets), "near-checked")
    links = checked.where(linked).select("a", "b")
    roots = freeze(components(links, "near-first"), "near-roots")

    outside = freeze(_outside(buckets, roots), "near-outside")
    # a component as a group: the nodes outside it that share a bucket, against all its members
    touching = outside.select(_group(1, "main.id", "main.mark"), "node", "root").distinct()
    # a bucket as a group: the nodes outside its largest component, if they are of several
    several = outside.groupBy("key").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("key")
    among = lookup(outside, several, ["key"], "left_semi", ["node"]).select(
        _group(0, "key", F.lit(0).cast("long")), "node", "root")
    members = freeze(_on(touching, LEFT).union(_on(_members(outside, roots), RIGHT)).union(_on(among, BOTH)),
                     "near-members")
    found = freeze(_block_links(members, sets, percent), "near-found")
    if not found.isEmpty():
        roots = _lifted(roots, components(found, "near-last"))
    best = roots.select(F.col("node.id").alias("_id"), F.col("node.mark").alias("_mark"),
                        F.col("root.id").alias("_root"))
    named = reps.drop("bands").join(best, (F.col("rep") == F.col("_id")) & (F.col("mark1") == F.col("_mark")),
                                    "left")
    named = freeze(named.select(*[F.col(c).alias(f"_{c}") for c in same],
                                F.coalesce("_root", "rep").alias("_component")), "near-named")
    joined = sig.drop("bands").join(named, [F.col(c) == F.col(f"_{c}") for c in same], "left")
    component = F.coalesce("_component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def _outside(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root, main): nodes of a bucket that are not in its largest component, ``main``."""
    placed = buckets.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("k"))
    mixed = main.where("k > 1").select("key", F.col("top.root").alias("main"))
    return placed.join(mixed, "key").where("root <> main")


def _group(kind: int, one: str, two: str | Column) -> Column:
    two = F.col(two) if isinstance(two, str) else two
    return F.struct(F.lit(kind).alias("kind"), F.col(one).alias("one"), two.alias("two")).alias("group")


LEFT, RIGHT, BOTH = 1, 2, 3


def _on(members: DataFrame, side: int) -> DataFrame:
    return members.withColumn("side", F.lit(side))


def _members(outside: DataFrame, roots: DataFrame) -> DataFrame:
    """(group, node, root): all nodes of the components that ``outside`` names as main."""
    mains = outside.select(F.col("main").alias("root")).distinct()
    own = lookup(roots, mains, ["root"], "left_semi", ["node"]).select("node", "root")
    alone = mains.join(roots.where("node = root").select("root"), "root", "left_anti").select(
        F.col("root").alias("node"), "root")
    return own.union(alone).select(_group(1, "root.id", "root.mark"), "node", "root")


def _lifted(roots: DataFrame, tops: DataFrame) -> DataFrame:
    """(node, root) after components were joined: ``tops`` has for roots (and nodes without links) their new root."""
    every = roots.union(tops.select("node", F.col("node").alias("root")))
    joined = lookup(every, tops.select(F.col("node").alias("root"), F.col("root").alias("top")), ["root"], "left", ["node"])
    return joined.select("node", F.coalesce("top", "root").alias("root")).distinct()


def _blocks(members: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """(group, ``side``): the nodes of each group with their sets, in blocks of bounded number and size."""
    sizes = members.groupBy("group").agg(F.ceil(F.greatest(
        F.count("*") / BLOCK, F.sum("node.n") / SHINGLES)).alias("_n"))
    block = F.pmod(F.xxhash64("node", "group"), F.col("_n"))
    return (lookup(members, sizes, ["group"], "inner", ["node"]).withColumn("_block", block).join(sets, "node")
            .groupBy("group", "_block").agg(F.collect_list(F.struct("node", "root", "shingles")).alias(side)))


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): for (group, node, root, side), the roots of a left node and a right component of a group
    between which there is some link."""
    left, right = (members.where(F.col("side").bitwiseAND(side) > 0).drop("side") for side in (LEFT, RIGHT))
    pairs = _blocks(left, sets, "xs").join(_blocks(right, sets, "ys"), "group").select("xs", "ys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbuf.hold("near dedup")
        for batch in batches:
            for i in range(batch.num_rows):
                xs, block = _unpack(batch.column(0), i), Block(_unpack(batch.column(1), i))
                links = [link for x in xs for link in block.links_of(x, percent)]
                if links:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dict(zip(_FIELDS, n, strict=True)) for n in side], _NODE) for side in zip(*links, strict=True)],
                        ["a", "b"])
    kind = f"struct<{', '.join(f'{c}: long' for c in _FIELDS)}>"
    return pairs.mapInArrow(run, f"a {kind}, b {kind}").distinct()


class Block:
    """The sets of a block as one sorted list of shingles with their owners: a set meets all of them at once."""

    def __init__(self, entries: list[tuple]):
        self.roots = [root for _, root, _ in entries]
        self.sizes = np.array([len(shingles) for _, _, shingles in entries])
        every = np.concatenate([shingles for _, _, shingles in entries])
        order = np.argsort(every, kind="stable")
        self.shingles, self.owner = every[order], np.repeat(np.arange(len(entries)), self.sizes)[order]

    def shared(self, shingles: np.ndarray) -> np.ndarray:
        """Size of the intersection with each set of the block."""
        low = np.searchsorted(self.shingles, shingles, "left")
        many = np.searchsorted(self.shingles, shingles, "right") - low
        ends = np.cumsum(many)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - many), many)
        return np.bincount(self.owner[at], minlength=len(self.sizes))

    def links_of(self, x: tuple, percent: int) -> Iterator[tuple]:
        """The roots on both sides of a link, once for each root of the block that ``x`` reaches."""
        _, root, shingles = x
        shared = self.shared(shingles)
        linked = 100 * shared >= percent * (len(shingles) + self.sizes - shared)
        for its_root in {self.roots[k] for k in np.flatnonzero(linked)} - {root}:
            yield min(root, its_root), max(root, its_root)


_FIELDS = ("id", "mark", "n")
_NODE = pa.struct([(c, pa.int64()) for c in _FIELDS])


def _unpack(column: pa.Array, row: int) -> list[tuple[tuple[int, ...], tuple[int, ...], np.ndarray]]:
    """Node, root and sorted shingles of the entries of a block."""
    entries = column[row].values
    lists = entries.field("shingles")
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)

    def names(field: str) -> Iterator[tuple[int, ...]]:
        parts = entries.field(field)
        return zip(*(parts.field(c).to_pylist() for c in _FIELDS), strict=True)

    return [(n, r, flat[ends[k]:ends[k + 1]])
            for k, (n, r) in enumerate(zip(names("node"), names("root"), strict=True))]


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """All columns of ``docs``, one row per group of near-duplicates.

    Rows without words and rows without doc_id belong to no group and stay.
    """
    bare = F.col("n_shingles") == 0
    kept = near_groups(docs, width, percent).where("kept").groupBy(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.count("*").alias("_n"), F.bool_or(bare).alias("_bare"))
    per_id = kept.where("NOT _bare AND _id IS NOT NULL").groupBy("_id").agg(
        F.sum("_n").alias("_rows"), F.min("_hash").alias("_first"))
    kept = freeze(kept.join(per_id.where("_rows > 1").select(F.col("_id").alias("_again"), "_first"),
                            (F.col("_id") == F.col("_again")) & ~F.col("_bare"), "left"), "near-kept")
    once, again = kept.where("_again IS NULL"), kept.where("_again IS NOT NULL AND _hash = _first")

    def those(keys: DataFrame) -> DataFrame:
        return packed(docs).join(growing(keys), F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id"))
                                 & (F.xxhash64("_row.text") == F.col("_hash")), "left_semi")

    stay = those(once)
    if not again.isEmpty():
        one = those(again).withColumn("_id", F.col("_row.doc_id")).dropDuplicates(["_id"]).drop("_id")
        stay = stay.unionByName(one)
    return stay.select("_row.*")
