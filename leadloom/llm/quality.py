"""Quality by regularised quadratic discriminant analysis over document statistics.

Each class is a Gaussian over transformed statistics of the whole text. Its covariance is
shrunk towards the pooled one and that towards its diagonal; the score is the logistic of the
difference of log densities, from Mahalanobis distances by cached Cholesky factors. The fit
needs only counts, sums and sums of products per class, which Spark adds up over all
labelled rows; what reaches the driver is of the square of the number of statistics.

Defined results: NULL text counts as empty and gets a score like any other; label values
other than 0 and 1 are not learned from, repeated labels count as often as they occur; if a
class has fewer than two rows every score is the share of label 1 (0.5 without labels); an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm import textbuf
from leadloom.session import freeze

_GROUPS = (b".,;:", b"!", b"?", b"#", b"$", b"%", b"&", b"*", b"|", b"\n", b"\"'()-", b"0123456789")
_CLASS = np.full(256, len(_GROUPS) + 4, dtype=np.int64)
_CLASS[97:123] = len(_GROUPS)
_CLASS[65:91] = len(_GROUPS) + 1
_CLASS[128:] = len(_GROUPS) + 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = len(_GROUPS) + 3
for _i, _chars in enumerate(_GROUPS):
    _CLASS[list(_chars)] = _i
N_CLASSES = len(_GROUPS) + 5
NAMES = [f"share{i}" for i in range(N_CLASSES)] + [
    "words", "word_length", "word_spread", "new_words", "lines", "new_lines", "upper_of_letters"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    share = counts / np.maximum(size, 1)[:, None]
    folded = textbuf.lower(data)
    start, end, begin = textbuf.words(folded, offsets)
    many = np.diff(begin)
    of = np.repeat(np.arange(n), many)
    length = (end - start).astype(float)
    mean = np.bincount(of, length, n) / np.maximum(many, 1)
    spread = np.sqrt(np.maximum(np.bincount(of, length ** 2, n) / np.maximum(many, 1) - mean ** 2, 0))
    fresh = np.diff(textbuf.distinct(textbuf.word_hashes(folded, start, end), begin)[1])
    first, last, line_begin = _lines(data, offsets)
    lines = np.diff(line_begin)
    own = np.diff(textbuf.distinct(textbuf.word_hashes(data, first, last), line_begin)[1])
    letters = counts[:, len(_GROUPS)] + counts[:, len(_GROUPS) + 1]
    upper = counts[:, len(_GROUPS) + 1] / np.maximum(letters, 1)
    # ratios of distinct to all are compared with what the size alone would give
    return np.column_stack([
        np.arcsinh(50 * share), np.log1p(many), np.log1p(mean), np.log1p(spread),
        np.log1p(fresh) - 0.8 * np.log1p(many), np.log1p(lines), np.log1p(lines - own), np.arcsinh(10 * upper)])


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each non-empty line, and where each text's lines begin."""
    inside = data != 0x0A
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(stops) + 1, np.searchsorted(start, offsets)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and one double per statistic, for every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbuf.hold("quality")
        for batch in batches:
            for first, end, data, offsets in textbuf.chunks(batch.column(1)):
                stats = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first),
                     *[pa.array(np.ascontiguousarray(stats[:, i])) for i in range(len(NAMES))]],
                    ["doc_id", *NAMES])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{n} double" for n in NAMES))


@dataclass(frozen=True)
class Discriminant:
    """Per class its mean, the inverse of its Cholesky factor and the log of its prior over volume."""
    means: tuple[np.ndarray, ...]
    inverse_factors: tuple[np.ndarray, ...]
    offsets: tuple[float, ...]
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        log = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1)
               for m, f, o in zip(self.means, self.inverse_factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(stats: DataFrame, labelled: DataFrame, label: str, pooled: float = 0.1,
        ridge: float = 0.05) -> Discriminant:
    """Fits from (doc_id, ``label``) rows joined to ``stats``; two rows of sums reach the driver."""
    pairs = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]
    known = labelled.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("_label"))
    joined = stats.join(known, "doc_id")
    long = joined.select("_label", F.posexplode(F.array(
        F.lit(1.0), *NAMES, *[F.col(NAMES[i]) * F.col(NAMES[j]) for i, j in pairs])).alias("k", "v"))
    rows = long.groupBy("_label", "k").agg(F.sum("v").alias("v")).collect()
    d = len(NAMES)
    sums = {c: np.zeros(1 + d + len(pairs)) for c in (0, 1)}
    for r in rows:
        sums[r["_label"]][r["k"]] = r["v"]
    n = {c: sums[c][0] for c in (0, 1)}
    total = n[0] + n[1]
    share = n[1] / total if total else 0.5
    if min(n.values()) < 2:
        return Discriminant((), (), (), share)
    means, scatter = [], []
    for c in (0, 1):
        mean = sums[c][1:d + 1] / n[c]
        square = np.zeros((d, d))
        for (i, j), v in zip(pairs, sums[c][d + 1:], strict=True):
            square[i, j] = square[j, i] = v
        means.append(mean)
        scatter.append(square - n[c] * np.outer(mean, mean))
    both = (scatter[0] + scatter[1]) / total
    base = np.diag(np.diag(both)) + 1e-4 * np.eye(d)
    inverse, offsets = [], []
    for c in (0, 1):
        cov = (1 - pooled) * scatter[c] / n[c] + pooled * both
        cov = (1 - ridge) * cov + ridge * base
        factor = np.linalg.cholesky(cov)
        inverse.append(np.linalg.inv(factor))
        offsets.append(float(np.log(n[c] / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(tuple(means), tuple(inverse), tuple(offsets), share)


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> DataFrame:
    """doc_id and score of every row of ``docs``; learned from the rows of ``labels`` where ``learn`` holds."""
    stats = freeze(document_statistics(docs), "quality-statistics")
    model = fit(stats, labels.where(learn), label)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.column_stack(cols)))

    return stats.select("doc_id", score(*NAMES).alias("score"))
