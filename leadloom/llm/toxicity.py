"""Toxicity of text restored through a noisy channel.

Words that look obfuscated (digits or signs among letters, letters repeated or set apart) are
read as a lattice of what each character may stand for, and the likeliest letters under a
character language model are found by a Viterbi search. Spaces and separators belong to the
lattice: each is either left out or kept as a word boundary. Pieces of a word set apart by
spaces are joined where the model finds the joined letters likelier; between plain pieces of
two or more letters that choice depends on the gap alone and is made for all gaps at once.
The model counts letter triples over every text of the corpus. The score comes from the restored words and their
beginnings: those that mark toxic texts in the labelled sample, summed and calibrated.

Bounds: the language model has 28**3 cells whatever the corpus; the classifier learns from
at most ``TRAIN_ROWS`` labelled rows (those with the smallest hash of their id), so its
features are bounded as well. Whole texts are scored.

Defined results: NULL text counts as empty and gets a score; label values other than 0 and
1 are not learned from, repeated labels count as often as they occur; without labels of both
kinds every score is the share of label 1 (0.5 without labels); an empty table gives no
rows; all columns of the input are kept and only the text is looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm import textbuf
from leadloom.session import freeze

TRAIN_ROWS = 20_000
PREFIXES = (3, 4, 5, 6, 7)
MIN_ROWS, MIN_LOG_ODDS, MIN_Z = 4, 1.4, 5.0
EDGE, OTHER, SYMBOLS = 0, 27, 28

# What a character may stand for. Letters stand for themselves, other signs for nothing.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t",
              "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "li", "*": "aeiou"}

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = OTHER
_LETTER = _SYMBOL > 0
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(b"@$")] = True
_CORE = _LETTER | _DIGIT
_REACH = _CORE.copy()
_REACH[[ord(c) for c in STANDS_FOR]] = True
_STANDS = re.compile(b"[" + re.escape("".join(STANDS_FOR)).encode() + b"]")
_APART = re.compile(rb"[^a-z0-9\x80-\xff" + re.escape("".join(STANDS_FOR)).encode() + rb"]")
_RIM = re.compile(r"^[^\w@$!+|*]+|[^\w@$!+|*]+$|^([@$!+|*])\1{2,}|([@$!+|*])\2{2,}$")
_LIKELY = _SYMBOL.copy()
for _c, _letters in STANDS_FOR.items():
    _LIKELY[ord(_c)] = ord(_letters[0]) - 96

# Gain in log likelihood from which a gap is joined, and from which both readings are looked at.
JOIN, MAYBE = 2.0, -3.0
# Spaces of a decoded run: between two single characters, and next to a longer piece.
_THIN, _WIDE = " ", "\n"


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the accented capitals of Latin-1 (two bytes in UTF-8)."""
    data = textbuf.lower(data)
    if len(data) > 1:
        second = data[1:]
        capital = (data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        data[1:] += capital.astype(np.uint8) << 5
    return data


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(letter | two letters before), counted over every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbuf.hold("toxicity")
        counts = np.zeros(SYMBOLS ** 3, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in textbuf.chunks(batch.column(0)):
                s = np.zeros(len(data) + 2 * len(offsets), dtype=np.int64)
                place = np.arange(len(data)) + 2 + 2 * np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                s[place] = _SYMBOL[fold(data)]
                at = s[:-2] * SYMBOLS ** 2 + s[1:-1] * SYMBOLS + s[2:]
                counts += np.bincount(at, minlength=SYMBOLS ** 3)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["cell", "n"])
    rows = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(
        F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS ** 3)
    for r in rows:
        counts[r["cell"]] = r["n"]
    cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.1
    return np.log(cube / cube.sum(axis=2, keepdims=True))


class Restorer:
    """Viterbi decoding of an obfuscated word or run of pieces into one or more words, with
    spaces between them; remembers the short ones it has decoded."""

    def __init__(self, model: np.ndarray, remember: int = 200_000):
        self.table, self.model, self.remember, self.known = model, model.tolist(), remember, {}

    def __call__(self, word: bytes) -> bytes:
        return self.readings(word)[0]

    def readings(self, word: bytes) -> tuple[bytes, ...]:
        """The likeliest reading and, if it left out signs that may stand for letters, the
        likeliest one with a letter for each of them."""
        out = self.known.get(word)
        if out is None:
            out = (self._decode(word, 4.0),)
            if _STANDS.search(word):
                out = tuple(dict.fromkeys((*out, self._decode(word, math.inf))))
            if len(self.known) < self.remember and len(word) <= 64:
                self.known[word] = out
        return out

    def _decode(self, word: bytes, left_out: float) -> bytes:
        text = _RIM.sub("", word.decode("utf-8", "replace"))
        text = re.sub(r"(.)\1{2,}", r"\1\1", text)
        # Per state its score and a chain of back-pointers (chain before, letter).
        paths = {(EDGE, EDGE): (0.0, None)}
        done, previous = [], ""
        for ch in text:
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for letter, c, cost in _options(ch, ch == previous, left_out):
                for (a, b), (score, chain) in paths.items():
                    if c < 0:
                        key, total = (a, b), score - cost
                    else:
                        key, total = (b, c), score - cost + self.model[a][b][c]
                    if key not in step or total > step[key][0]:
                        step[key] = total, (chain if c < 0 else (chain, letter))
            if len(step) == 1 < len(paths):  # all paths have met: what led here is settled
                (key, (_, chain)), = step.items()
                step = {key: (0.0, None)}
                done.append(_spell(chain))
            paths, previous = step, ch
        best = max((score + self.model[a][b][EDGE], _spell(chain)) for (a, b), (score, chain) in paths.items())
        return b" ".join(("".join(done) + best[1]).encode().split())


@lru_cache(maxsize=10_000)
def _options(ch: str, repeated: bool, left_out: float) -> list[tuple[str | None, int, float]]:
    """(letter or None for nothing, its symbol or -1, cost) for one character of the lattice."""
    if ch == _WIDE:
        options = [(" ", 0.0), (None, JOIN)]
    elif ch.isalpha():
        options = [(ch, 0.0), (None, 1.0)] if repeated else [(ch, 0.0)]
    elif ch in STANDS_FOR:
        stands = STANDS_FOR[ch]
        options = [(c, 0.7 + math.log(len(stands))) for c in stands]
        if repeated or left_out < math.inf:
            options.append((None, 1.0 if repeated else left_out))
    else:
        options = [(None, 0.7), (" ", 0.7)]
    return [(c, -1 if c is None else _code(c), cost) for c, cost in options]


def _spell(chain: tuple | None) -> str:
    letters = []
    while chain is not None:
        chain, letter = chain
        letters.append(letter)
    return "".join(reversed(letters))


def _code(letter: str) -> int:
    return EDGE if letter == " " else ord(letter) - 96 if "a" <= letter <= "z" else OTHER


def _cores(data: np.ndarray, start: np.ndarray, end: np.ndarray,
           kind: np.ndarray = _CORE) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without leading and trailing signs; words without letters or digits (bytes of
    ``kind``) become empty."""
    solid = kind[data]
    before = np.concatenate([[0], np.cumsum(solid)])
    where = np.flatnonzero(solid)
    has = before[end] > before[start]
    first, last = start.copy(), start.copy()
    first[has] = where[before[start][has]]
    last[has] = where[before[end][has] - 1] + 1
    return first, last


def _odd_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray,
               last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words have a letter and something that may hide one: inside (other characters, or
    a letter twice in a row) and at an edge (signs before it, or right behind its last letter)."""
    letter = _LETTER[data]
    letters = np.concatenate([[0], np.cumsum(letter)])
    signs = np.concatenate([[0], np.cumsum(_SIGN[data])])
    stands = np.concatenate([[0], np.cumsum(_REACH[data] & ~_CORE[data])])
    twice = np.zeros(len(data), dtype=np.int64)  # at its last byte, how many bytes the pair has
    for size, low, high in ((1, 0x61, 0x7A), (2, 0xC3, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF4)):
        if len(data) >= 2 * size:
            same = data[size:] == data[:-size]
            run = same[:len(same) - size + 1].copy()
            for k in range(1, size):
                run &= same[k:len(same) - size + 1 + k]
            head = data[:len(run)]
            twice[2 * size - 1:] += run & (head >= low) & (head <= high)
    pairs = np.concatenate([[0], np.cumsum(twice > 0)])
    has = letters[last] > letters[first]
    mixed = letters[last] - letters[first] < last - first
    drawn = pairs[last] > pairs[np.minimum(first + 1, last)]
    behind = np.minimum(last, len(data) - 1)
    touched = (last < end) & (stands[behind + 1] > stands[behind]) & letter[last - 1]
    edge = (signs[end] - signs[start] > signs[last] - signs[first]) | (stands[first] > stands[start]) | touched
    return has & (mixed | drawn), has & edge


def _gains(model: np.ndarray, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each gap between neighbours, how much likelier its letters are joined than set apart."""
    sym, size = _LIKELY[data], last - first
    left, right = np.minimum(last[:-1], len(data)) - 1, np.minimum(first[1:], len(data) - 1)
    a = np.where(size[:-1] > 1, sym[left - 1], EDGE)
    b, c, d = sym[left], sym[right], sym[np.minimum(right + 1, len(data) - 1)]
    gain = model[a, b, c] - model[a, b, EDGE] - model[b, EDGE, c]
    return gain + np.where(size[1:] > 1, model[b, c, d] - model[EDGE, c, d], 0.0)


def _pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds with the signs at an edge that may stand for a letter; two or more of them at
    the end are punctuation, unless the word has nothing else."""
    first, last = _cores(data, start, end, _REACH)
    inner, core = _cores(data, start, end)
    return first, np.where((core > inner) & (last - core > 1), core, last)


def _joined(model: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray,
            begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours that may be pieces of a word: single (per word), the runs for the decoder and
    those of plain pieces only, each as (first word, end word), and the first of each plain pair."""
    first, last = _pieces(data, start, end)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    there = last > first
    single = there & (lead[last] - lead[first] == 1)
    mixed = letters[last] - letters[first] < last - first
    open_ = there[:-1] & there[1:]
    inner = begin[(begin > 0) & (begin < len(start))]
    open_[inner - 1] = False
    gain = np.where(open_, _gains(model, data, first, last), -np.inf)
    spaced = open_ & single[:-1] & single[1:]
    sign = there & ~(_CORE[data[np.minimum(first, len(data) - 1)]])  # only stands for a letter at a cost
    link = spaced | (gain > JOIN + math.log(4) * (sign[:-1] | sign[1:]))
    tied = np.concatenate([[False], link, [False]])
    a, b = np.flatnonzero(tied[1:] & ~tied[:-1]), np.flatnonzero(~tied[1:] & tied[:-1]) + 1
    count = np.concatenate([[0], np.cumsum(mixed | np.concatenate([spaced, [False]]))])
    hard = count[b] > count[a]
    read = hard & (letters[end[b - 1]] > letters[start[a]])
    pairs = np.flatnonzero((gain > MAYBE) & ~mixed[:-1] & ~mixed[1:])
    return single, np.column_stack([a, b])[read], a[~hard], b[~hard], pairs


def _run_texts(text: bytes, start: np.ndarray, end: np.ndarray, single: np.ndarray, a: int,
               b: int) -> tuple[bytes, list[bytes]]:
    """The pieces a to b as one text for the decoder, and each part of single characters without spaces."""
    out, parts, alone = [], [], []
    for i in range(a, b):
        piece = text[start[i]:end[i]]
        if out:
            out.append((_THIN if single[i - 1] and single[i] else _WIDE).encode())
        out.append(piece)
        if single[i]:
            alone.append(piece)
        if alone and (not single[i] or i == b - 1):
            if len(alone) > 2:
                parts.append(b"".join(alone))
            alone = []
    return b"".join(out), parts


def _word_features(hashes: Callable, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words and of their beginnings; 0 where a word has no such beginning."""
    out = [hashes(first, last)]
    for k in PREFIXES:
        long = last - first > k
        h = np.zeros(len(first), dtype=np.uint64)
        h[long] = hashes(first[long], first[long] + k) ^ np.uint64(k)
        out.append(h)
    return out


def features(data: np.ndarray, offsets: np.ndarray, restore: Restorer) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, feature) pairs of a chunk in a few arrays: plain words, then restored ones."""
    data = fold(data)
    start, end, begin = textbuf.words(data, offsets)
    if not len(start):
        return
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    first, last = _cores(data, start, end)
    hashes = textbuf.word_hasher(data)
    for h in _word_features(hashes, first, last):
        yield doc, h
    text = data.tobytes()
    # What the decoder reads is numbered: equal words of the chunk once, each run for itself.
    found: dict[tuple[int, bytes], None] = {}
    spelled: dict[tuple[int, bytes], None] = {}
    docs, numbers, count = [], [], 0
    inside, edge = _odd_words(data, start, end, first, last)
    for odd, left, right in ((inside, first, last), (edge, start, end)):
        at = np.flatnonzero(odd)
        _, one, number = np.unique(hashes(left[at], right[at]), return_index=True, return_inverse=True)
        for k, i in enumerate(at[one].tolist(), count):
            piece = text[left[i]:right[i]]
            for reading in restore.readings(piece):
                if reading != piece:
                    whole = reading.replace(b" ", b"")
                    for word in (*reading.split(), whole):
                        found[k, word] = None
                    if len(whole) > 2 and len(_APART.findall(piece)) + 1 >= len(whole.decode("utf-8", "replace")):
                        spelled[k, whole] = None
        docs.append(doc[at])
        numbers.append(number + count)
        count += len(one)
    single, runs, a, b, pairs = _joined(restore.table, data, start, end, begin)
    for k, (i, j) in enumerate(runs.tolist(), count):
        run, parts = _run_texts(text, start, end, single, i, j)
        for reading in (*restore.readings(run), *(r for p in parts for r in restore.readings(p))):
            for word in reading.split():
                found[k, word] = None
        for part in parts:
            for reading in restore.readings(part):
                spelled[k, reading.replace(b" ", b"")] = None
    docs.append(doc[runs[:, 0]])
    numbers.append(np.arange(count, count + len(runs)))
    count += len(runs)
    if len(pairs):
        bounds = np.zeros(len(data) + 1, dtype=np.int8)
        bounds[first[last > first]] += 1
        bounds[last[last > first]] -= 1
        keep = np.cumsum(bounds[:-1], dtype=np.int8) > 0
        to = np.concatenate([[0], np.cumsum(keep)])
        hashes, first_in, last_in = textbuf.word_hasher(data[keep]), to[first], to[last]
        yield doc[pairs], hashes(first_in[pairs], last_in[pairs + 1])
        for h in _word_features(hashes, first_in[a], last_in[b - 1]):
            yield doc[a], h
    seen = np.unique(np.concatenate(docs) * count + np.concatenate(numbers)) if count else np.zeros(0, np.int64)
    of = seen // max(count, 1)
    if found:
        number, joined, from_, to = _listed(found)
        at, times = _places(number, seen % count, count)
        for h in _word_features(textbuf.word_hasher(joined), from_, to):
            yield np.repeat(of, times), h[at]
    if spelled:
        number, joined, from_, to = _listed(spelled)
        size = to - from_
        number, stop = np.repeat(number, size), np.repeat(to, size)
        place = np.arange(len(number)) + np.repeat(from_ - (np.cumsum(size) - size), size)
        at, times = _places(number, seen % count, count)
        of, place, stop = np.repeat(of, times), place[at], stop[at]
        for k in PREFIXES:  # a word may begin at every letter that is set apart
            long = stop - place >= k
            h = textbuf.word_hashes(joined, place[long], place[long] + k)
            yield of[long], h
            if k == PREFIXES[-1]:
                yield of[long], h ^ np.uint64(k)


def _places(number: np.ndarray, wanted: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in the ascending ``number`` the entries of each wanted one are, and how many it has."""
    times = np.bincount(number, minlength=count)
    begin = (np.cumsum(times) - times)[wanted]
    times = times[wanted]
    return np.arange(times.sum()) + np.repeat(begin - (np.cumsum(times) - times), times), times


def _listed(words: dict[tuple[int, bytes], None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each word that is not empty, all words in one buffer, and their bounds there."""
    joined = np.frombuffer(b" ".join(w for _, w in words), dtype=np.uint8)
    sizes = np.array([len(w) for _, w in words])
    to = np.cumsum(sizes + 1) - 1
    there = sizes > 0
    return np.array([d for d, _ in words])[there], joined, (to - sizes)[there], to[there]


@dataclass(frozen=True)
class ToxicityModel:
    language: np.ndarray
    keys: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def evidence(self, data: np.ndarray, offsets: np.ndarray, restore: Restorer) -> np.ndarray:
        """Per text the summed weights of the distinct features that the model knows."""
        n = len(offsets) - 1
        total = np.zeros(n)
        if not len(self.keys):
            return total
        gate = np.zeros(1 << 16, dtype=bool)
        gate[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        docs, hits = [], []
        for doc, h in features(data, offsets, restore):
            some = np.flatnonzero(gate[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
            true = self.keys[at] == h[some]
            docs.append(doc[some[true]])
            hits.append(at[true])
        if docs:
            pair = np.unique(np.concatenate(docs) * len(self.keys) + np.concatenate(hits))
            total = np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], n).astype(float)
        return total

    def score(self, data: np.ndarray, offsets: np.ndarray, restore: Restorer) -> np.ndarray:
        z = self.slope * self.evidence(data, offsets, restore) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve by damped Newton steps, with a little shrinkage."""
    scale = max(float(np.abs(x).max(initial=0.0)), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (y - p) - 1e-3 * w
        curve = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic",
          rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Language model over all ``docs``; classifier from at most ``rows`` labelled ones."""
    language = language_model(docs)
    sample = freeze(labels.where(learn & F.col(label).isin(0, 1)).select(
        F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).orderBy(
        F.xxhash64("_id"), "_id", "_label").limit(rows), "toxic-sample")
    texts = freeze(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
                   .select("text", "_label"), "toxic-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbuf.hold("toxicity")
        restore = Restorer(language)
        for batch in batches:
            y = batch.column(1).to_numpy()
            for first, _, data, offsets in textbuf.chunks(batch.column(0)):
                parts = list(features(data, offsets, restore))
                if not parts:
                    continue
                doc = np.concatenate([d for d, _ in parts])
                h = np.concatenate([x for _, x in parts])
                order = np.lexsort((doc, h))
                doc, h = doc[order], h[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) & (h != 0)
                doc, h = doc[new], h[new]
                if not len(h):
                    continue
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                bad = y[first + doc].astype(np.int64)
                n1 = np.add.reduceat(bad, at)
                n = np.diff(np.concatenate([at, [len(h)]]))
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(n1),
                                                  pa.array(n - n1)], ["feature", "n1", "n0"])

    sizes = {r["_label"]: r["n"] for r in texts.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    t1, t0 = sizes.get(1, 0), sizes.get(0, 0)
    none = np.zeros(0, dtype=np.uint64)
    if not t1 or not t0:
        share = min(max(t1 / (t1 + t0) if t1 + t0 else 0.5, 1e-6), 1 - 1e-6)
        return ToxicityModel(language, none, np.zeros(0), 0.0, math.log(share / (1 - share)))
    p1 = (F.col("n1") + 0.5) / (t1 + 1)
    p0 = (F.col("n0") + 0.5) / (t0 + 1)
    pool = (F.col("n1") + F.col("n0")) / (t1 + t0)
    z = (F.col("n1") / t1 - F.col("n0") / t0) / F.sqrt(pool * (1 - pool) * (1 / t1 + 1 / t0) + 1e-12)
    told = (texts.select("text", "_label").mapInArrow(count, "feature long, n1 long, n0 long")
            .groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
            .where(F.col("n1") >= MIN_ROWS)
            .select("feature", F.log(p1 / p0).alias("weight"), z.alias("z"))
            .where((F.col("weight") >= MIN_LOG_ODDS) & (F.col("z") >= MIN_Z)).toPandas())
    keys = told["feature"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    rough = ToxicityModel(language, keys[order], told["weight"].to_numpy(dtype=float)[order], 1.0, 0.0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbuf.hold("toxicity")
        restore = Restorer(language)
        for batch in batches:
            for first, end, data, offsets in textbuf.chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rough.evidence(data, offsets, restore)),
                     batch.column(1).slice(first, end - first)], ["x", "y"])

    points = texts.mapInArrow(weigh, "x double, y int").toPandas()
    slope, shift = _calibrate(points["x"].to_numpy(dtype=float), points["y"].to_numpy(dtype=float))
    return ToxicityModel(language, rough.keys, rough.weights, slope, shift)


def score_toxicity(docs: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """``docs`` with every column and the score of each text as ``name``, row by row, no shuffle."""
    at = docs.columns.index("text")
    kind = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbuf.hold("toxicity")
        restore = Restorer(model.language)
        for batch in batches:
            for first, end, data, offsets in textbuf.chunks(batch.column(at)):
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(model.score(data, offsets, restore))],
                    [*part.schema.names, name])
    return docs.mapInArrow(run, kind)


def clean_documents(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns unchanged."""
    name = "toxicity"
    while name in docs.columns:
        name = f"_{name}"
    scored = score_toxicity(docs, train(docs, labels, learn), name)
    return scored.where(F.col(name) < threshold).drop(name)
