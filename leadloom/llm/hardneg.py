"""Hard negatives by Fagin's threshold algorithm over blocks of rows.

Rows and anchors are dealt by hash into blocks of bounded size; Spark groups every block of
rows with every block of anchors (the anchors are a stated query set, so this is the
query set against all rows, in blocks). Within a group each dimension has one list of
the block's rows, sorted by that component. For an anchor the lists are read from the end
that its component's sign prefers (sorted access), every row met is scored whole
(random access), and reading stops once the threshold, the best score that a row not yet met
can have, is strictly below the kth score of what is looked for. Results of the blocks are merged
with a ranking that Spark cuts before its shuffle. All scores are exact integers.

Two searches: the first ``n_positives`` rows of the anchor's label, then per positive the first
``n_negatives`` rows of other labels in its window, 50 p <= 100 s <= 95 p for its score p; a window is
also done when the threshold is below its lower end.

Defined results: rows with a NULL vec_id, label, vector or component, or a component that is not
finite, take no part; rows that repeat id, label and vector are one row; further rows with the
anchor's own id are never its positives; equal ids are ordered by label, then by a hash; shorter
vectors count as padded with zeros; quantised components are held within +-2^23, so that sums stay
exact; anchors without positives, and positives without negatives, give no rows; no rows give
no rows; other columns are not looked at.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.session import freeze

ROWS_PER_BLOCK = 8192
ANCHORS_PER_BLOCK = 256
LIMIT = 1 << 23
N_POSITIVES, N_NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # window in percent of the positive's score


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (integers), key: the rows that take part, each once."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    held = lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c.cast("double") * 256)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & whole).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("bigint").alias("label"),
        F.transform(x, lambda c: held(c).cast("int")).alias("v")).distinct()
    return rows.withColumn("key", F.xxhash64("vec_id", "label", "v"))


def _padded(rows: DataFrame, dims: int) -> DataFrame:
    gap = F.lit(dims) - F.size("v")
    return rows.withColumn("v", F.when(gap > 0, F.concat("v", F.array_repeat(F.lit(0), gap))).otherwise(F.col("v")))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if n else pa.array([], pa.int32())
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


class Lists:
    """Rows of a block with one sorted list per dimension."""

    def __init__(self, values: np.ndarray):
        # sums of products below 2^24 are exact in single precision; all others in double (LIMIT)
        top = float(np.abs(values).max(initial=0))
        self.single = top * top * values.shape[1] < 1 << 24
        self.values = values
        self.ranked = np.argsort(values, axis=0, kind="stable")
        self.narrow = values.astype(np.float32) if self.single else values

    def scan(self, anchor: np.ndarray, done):
        """Scores of the rows met; ``done(scores, met, threshold)`` says when to stop reading.

        ``met`` marks the rows with a score. The depth grows by a half each time, so at most
        that much is read beyond the stop.
        """
        n = len(self.values)
        met, scores = np.zeros(n, dtype=bool), np.zeros(n)
        used = np.flatnonzero(anchor)
        up = used[anchor[used] < 0]
        down = used[anchor[used] > 0]
        top = np.abs(anchor).max(initial=0)
        exact = self.single and top * np.abs(self.values).max(initial=0) * len(anchor) < 1 << 24
        vector = anchor.astype(np.float32) if exact else anchor
        table = self.narrow if exact else self.values
        depth, begin = max(8, n // 16), 0
        if not len(used):  # every score is 0: all rows tie
            met[:] = True
            done(scores, met, -np.inf)
            return scores, met
        while begin < n:
            depth = min(depth, n)
            fresh = np.zeros(n, dtype=bool)
            fresh[self.ranked[begin:depth, up]] = True
            fresh[self.ranked[n - depth:n - begin, down]] = True
            rows = np.flatnonzero(fresh & ~met)
            scores[rows] = table[rows] @ vector
            met[rows] = True
            last_up, last_down = self.ranked[depth - 1, up], self.ranked[n - depth, down]
            threshold = anchor[up] @ self.values[last_up, up] + anchor[down] @ self.values[last_down, down]
            if depth == n or met.all():
                threshold = -np.inf
            if done(scores, met, threshold) or threshold == -np.inf:
                break
            begin, depth = depth, depth + max(8, depth // 2)
        return scores, met


def _best(scores: np.ndarray, order: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of ``rows``: higher scores, then smaller places in ``order``."""
    if len(rows) > k:
        kth = np.partition(scores[rows], len(rows) - k)[len(rows) - k]
        rows = rows[scores[rows] >= kth]
    return rows[np.lexsort((order[rows], -scores[rows]))][:k]


def _kth(scores: np.ndarray, rows: np.ndarray, k: int) -> float:
    return np.partition(scores[rows], len(rows) - k)[len(rows) - k] if len(rows) >= k else -np.inf


#: Order of rows with equal scores; ``key`` only tells rows of one id and label apart.
TIES = ("vec_id", "label", "key")
_FOUND = pa.schema([(c, pa.int64()) for c in ("anchor_key", "anchor_id", "positive_key", "positive_id",
                                              "positive_score", *TIES, "score")])


def _positives(rows: pa.Table, anchors: pa.Table, k: int):
    """For each anchor of the group the block's first ``k`` other rows of its label."""
    ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
    values, own = _matrix(rows.column("v"), len(ids)), _matrix(anchors.column("v"), anchors.num_rows)
    of_label = {}
    for label in np.unique(anchors.column("label").to_numpy()):
        at = np.flatnonzero(labels == label)
        of_label[label] = (at, Lists(values[at]))
    for j, (key, anchor, label) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("key", "vec_id", "label")),
                                                 strict=True)):
        at, lists = of_label[label]
        other = ids[at] != anchor
        done = lambda s, met, t: t < _kth(s, np.flatnonzero(met & other), k)  # noqa: B023, E731
        scores, met = lists.scan(own[j], done)
        for i in _best(scores, at, np.flatnonzero(met & other), k):
            yield (key, anchor, None, None, None), at[i], int(scores[i])


def _negatives(rows: pa.Table, anchors: pa.Table, k: int):
    """For each positive of each anchor the block's first ``k`` rows of other labels in its window."""
    labels = rows.column("label").to_numpy()
    lists = Lists(_matrix(rows.column("v"), len(labels)))
    own, order = _matrix(anchors.column("v"), anchors.num_rows), np.arange(len(labels))
    for j, (key, anchor, label, positives) in enumerate(zip(
            *(anchors.column(c).to_pylist() for c in ("key", "vec_id", "label", "positives")), strict=True)):
        other = labels != label
        windows = [(p, -(-LOW * p["score"] // 100), HIGH * p["score"] // 100) for p in positives]
        windows = [w for w in windows if w[1] <= w[2]]

        def inside(s, met, low, high):
            return np.flatnonzero(met & other & (s >= low) & (s <= high))  # noqa: B023

        def done(s, met, t):
            return all(t < low or t < _kth(s, inside(s, met, low, high), k) for _, low, high in windows)  # noqa: B023

        if windows:
            scores, met = lists.scan(own[j], done)
            for p, low, high in windows:
                for i in _best(scores, order, inside(scores, met, low, high), k):
                    yield (key, anchor, p["key"], p["vec_id"], p["score"]), i, int(scores[i])


def _search(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, find, k: int) -> DataFrame:
    """``find`` on every block of rows with every block of anchors."""
    row_blocks, anchor_blocks = max(1, ceil(n_rows / ROWS_PER_BLOCK)), max(1, ceil(n_anchors / ANCHORS_PER_BLOCK))

    def blocks(df: DataFrame, n: int, m: int, own: str, other: str) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("key", F.lit(1)), F.lit(n))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint"))))

    left = blocks(rows, row_blocks, anchor_blocks, "_r", "_a").groupBy("_r", "_a")
    right = blocks(anchors, anchor_blocks, row_blocks, "_a", "_r").groupBy("_r", "_a")

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not block.num_rows or not asked.num_rows:
            return _FOUND.empty_table()
        block = block.sort_by([(c, "ascending") for c in TIES])
        heads, picks, scores = [], [], []
        for head, i, score in find(block, asked, k):
            heads.append(head)
            picks.append(i)
            scores.append(score)
        took = block.take(pa.array(picks, pa.int64()))
        columns = list(zip(*heads, strict=True)) or [()] * 5
        return pa.Table.from_arrays([*[pa.array(c, pa.int64()) for c in columns],
                                     *[took.column(c) for c in TIES], pa.array(scores, pa.int64())], schema=_FOUND)

    return left.cogroup(right).applyInArrow(run, ", ".join(f"{c} long" for c in _FOUND.names))


def _first(found: DataFrame, group: list[str], k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), *TIES)
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def hard_negatives(vectors: DataFrame, anchor_every: int = 50, n_positives: int = N_POSITIVES,
                   n_negatives: int = N_NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id ``anchor_every`` divides.
    """
    rows = freeze(quantised(vectors), "vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % anchor_every == 0).alias("anchors"),
                     F.max(F.size("v")).alias("dims")).first()
    n, n_anchors = sizes["n"], sizes["anchors"]
    rows = _padded(rows, sizes["dims"] or 0)
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    near = freeze(_first(_search(rows, anchors, n, n_anchors, _positives, n_positives), ["anchor_key"],
                         n_positives, "_n"), "positives")
    theirs = near.groupBy(F.col("anchor_key").alias("key")).agg(
        F.collect_list(F.struct("key", "vec_id", "score")).alias("positives"))
    asked = freeze(anchors.join(theirs, "key"), "anchors")
    found = _search(rows, asked, n, n_anchors, _negatives, n_negatives)
    return _first(found, ["anchor_key", "positive_key"], n_negatives, "rank").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
