"""Texts of an Arrow batch as one UTF-8 buffer, cut into words with numpy.

Used inside mapInArrow: Spark places the rows, these helpers replace a loop over words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


_held: dict[str, object] = {}


def hold(name: str, make=None):
    """What an operator keeps in a worker process between tasks; what others kept is let go.

    Workers are reused by later stages, so without this every operator's memory would add up.
    """
    for other in [k for k in _held if k != name]:
        del _held[other]
    if make is not None and name not in _held:
        _held[name] = make()
    return _held.get(name)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits; a bijection."""
    h = h ^ (h >> np.uint64(30))
    h *= _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    return h ^ (h >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): rows of together at most ``limit`` bytes, one at least."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(texts))
        cut = raw[offsets[first]:offsets[end]]
        yield first, end, cut, offsets[first:end + 1] - offsets[first]
        first = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text where its words begin (one more at the end).

    A word is a run without ASCII white space; a word never spans two texts.
    """
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(start, offsets)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inverse)):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            table = np.cumprod(row, dtype=np.uint64)
            if size > CHUNK + 1:  # not kept: a very long text must not hold memory for good
                _powers_long[key] = table
            else:
                _powers[key] = table
        if size > CHUNK + 1:
            return _powers_long.pop("up"), _powers_long.pop("down")
    return _powers["up"], _powers["down"]


_powers_long: dict[str, np.ndarray] = {}


def word_hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """From (start, end) a 64-bit hash of each word's bytes: a polynomial from prefix sums, then
    mixed with its length."""
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return lambda start, end: mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MIX1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of :func:`word_hasher` for one list of words."""
    return word_hasher(data)(start, end) if len(start) else np.zeros(0, dtype=np.uint64)


def shingle_hashes(h: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row within a text, and where each text's hashes begin.

    A text of fewer words has one hash, of all its words; one without words has none.
    """
    counts = np.diff(begin)
    many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_begin = np.zeros(len(begin), dtype=np.int64)
    np.cumsum(many, out=out_begin[1:])
    first = np.repeat(begin[:-1] - out_begin[:-1], many) + np.arange(out_begin[-1])
    size = np.repeat(np.minimum(counts, width), many)
    acc = size.astype(np.uint64) * _MIX2
    for k in range(width):
        there = size > k
        at = np.where(there, first + k, 0)
        acc = np.where(there, mix(acc * _BASE + h[at]) if len(h) else acc, acc)
    return acc, out_begin


def distinct(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text sorted and without repeats, and where each text's begin."""
    h = h.copy()
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = h[1:] != h[:-1]
    inner = begin[:-1]
    keep[inner[inner < len(h)]] = True
    total = np.zeros(len(h) + 1, dtype=np.int64)
    np.cumsum(keep, out=total[1:])
    return h[keep], total[begin]
