"""Documents as token ids in a binary format with Elias-Fano document boundaries.

Format. A data set is a folder of Parquet files (so any store and Spark's commit protocol
serve) whose rows are blocks of consecutive documents:

=========  ===========================================================================
part, seq  range partition of the block and its number there; blocks in this order
docs       number of documents; ``tokens`` number of ids
doc_ids    the documents' ids, one long each (NULL kept)
ids        all ids of the block one after another, little-endian, ``id_bytes`` (2 or 4) each
low_bits   l: how many low bits of each boundary are stored plainly
low        the l low bits of every boundary, packed
high       the rest in unary: boundary i sets bit (boundary >> l) + i
samples    select support: position in ``high`` of every 256th set bit
=========  ===========================================================================

Boundary i is where document i ends, so it starts at boundary i - 1. The n boundaries of
u ids take about n * (2 + log2(u / n)) bits. ``EliasFano.select`` reads one boundary from a
sample and a short scan, ``EliasFano.range`` those of a run of documents in the same way.

Defined results: NULL text counts as empty, which is encoded as the end id alone; documents
are in ascending doc_id order, NULL ids first, rows with equal ids in any order but each
on its own; an empty table gives a data set without blocks; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import ChainMap
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm import textbuf
from leadloom.session import freeze, scratch_path

BLOCK_TOKENS = 1 << 20
END_ID = 0
SAMPLE = 256
READ_RUN = 64 * SAMPLE
CALL = 1 << 12  # texts in one call of the library
CHUNK = 1 << 20  # bytes of text encoded at a time
PIECES = 1 << 18  # bytes of text cut into pieces at a time: these and the library's tokens are held together
REMEMBER = 400_000  # words and pieces of text that an encoder keeps, some 130 bytes each
SPAN = 1 << 16  # characters after which a long text may be cut
BLOCK_SCHEMA = ("part int, seq int, docs int, tokens long, id_bytes int, low_bits int, "
                "doc_ids array<long>, low binary, high binary, samples binary, ids binary")


class EliasFano:
    """A non-decreasing sequence of numbers in near-minimal space."""

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.count, self.low_bits, self.low, self.high = count, low_bits, low, high
        self.samples = np.frombuffer(samples, dtype="<u4")

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        lows = (values[:, None] >> np.arange(low_bits)) & 1
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, np.packbits(lows.astype(np.uint8).reshape(-1), bitorder="little").tobytes(),
                   np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def all(self) -> np.ndarray:
        return self.range(0, self.count)

    def range(self, first: int, stop: int) -> np.ndarray:
        """Values ``first`` up to ``stop``: only the bits between their samples are looked at."""
        if stop <= first:
            return np.zeros(0, dtype=np.int64)
        at, after = int(self.samples[first // SAMPLE]), -(-stop // SAMPLE)
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high[at // 8:-(-end // 8)], dtype=np.uint8), bitorder="little")
        ones = np.flatnonzero(bits[at % 8:])[first % SAMPLE:][:stop - first].astype(np.int64) + at
        value = (ones - np.arange(first, stop)) << self.low_bits
        if self.low_bits:
            begin, over = divmod(first * self.low_bits, 8)
            lows = np.frombuffer(self.low[begin:-(-stop * self.low_bits // 8)], dtype=np.uint8)
            lows = np.unpackbits(lows, bitorder="little")[over:][:len(value) * self.low_bits]
            value |= (lows.reshape(-1, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return value

    def select(self, i: int) -> int:
        """Value number ``i``: from the nearest sample on, at most SAMPLE set bits are passed."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        word = self.high[byte] & (0xFF << at % 8 & 0xFF)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        value = place - i << self.low_bits
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= (self.low[bit // 8] >> bit % 8 & 1) << k
        return value


_PAIRS = ["  ", " \n", " \t", " \r", " \x0b", " \x0c", " \x1c", " \x1d", " \x1e", " \x1f"]
# A space between ASCII letters or digits: no word of the splitter has a space after its first character.
_PLAIN = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
_RARE = re.compile(r"[^\S\x00-\x20]")

# Characters whose kind (letter, digit, space, other) Python's classes tell as the splitter's do,
# and the splitter's words over them.
_COMMON = re.compile(r"[\x20-\x7e\n\t\r\xc0-\u024f]+")
_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

# The kind of every byte of the common characters; bytes of other characters are odd.
_SPACE, _LETTER, _DIGIT, _OTHER, _UNCOMMON = range(5)
_KIND = np.full(256, _UNCOMMON, dtype=np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER

# The characters by which a byte-level model spells the bytes 1 to 255: visible ones stand for themselves, the others
# for 256, 257, … in order, byte 0 being the first of these.
_SPELLED = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if not (
    0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)) if b}


def _word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the splitter's words begin in the texts of a buffer, and in which texts they cannot be told so: texts
    with other characters than the common ones, or with a space before white space or at the end."""
    kind = _KIND[data]
    lead = np.flatnonzero(data >= 0xC3)
    head, after = data[lead], data[lead + 1]
    signs = lead[(head == 0xC3) & ((after == 0x97) | (after == 0xB7))]
    kind[signs] = kind[signs + 1] = _OTHER
    kind[lead[(head == 0xC9) & (after > 0x8F)]] = _UNCOMMON

    begin = np.zeros(len(data) + 1, dtype=bool)
    begin[offsets] = True
    last = begin[1:]
    space, white = data == 0x20, kind == _SPACE
    before_white = np.zeros(len(data), dtype=bool)
    before_white[:-1] = white[1:]
    uncommon = np.flatnonzero((kind == _UNCOMMON) | space & (last | before_white))
    odd = np.zeros(len(offsets) - 1, dtype=bool)
    odd[np.searchsorted(offsets, uncommon, "right") - 1] = True

    starts = begin[:-1].copy()
    starts[1:] |= (kind[1:] != kind[:-1]) & ~space[:-1]
    starts |= space
    starts |= white & ~before_white & ~last  # of several white characters the last stands alone before a word
    quote = np.flatnonzero((data == 0x27) & starts & ~last)
    if len(quote):
        one = quote[np.isin(data[quote + 1], np.frombuffer(b"stmd", dtype=np.uint8))]
        starts[one + 1] = False
        starts[(one + 2)[one + 2 < len(data)]] = True
        two = quote[~begin[np.minimum(quote + 2, len(data))]]
        pair = data[two + 1].astype(np.int64) << 8 | data[two + 2]
        two = two[np.isin(pair, [int.from_bytes(p) for p in (b"re", b"ve", b"ll")])]
        starts[two + 1] = False
        starts[(two + 3)[two + 3 < len(data)]] = True
    return starts, odd


class Encoder:
    """Whole texts to ids with a tokenizers file, remembering the ids of pieces of text.

    Texts of common characters are cut into the splitter's words all at once, as bytes; Arrow
    finds the distinct ones, and only those not seen before go through the library's model.

    Of other texts: a byte-level tokenizer never joins across a space that a visible character follows,
    so a text is cut there and each piece has ids of its own. Pieces seen before come from
    memory, new ones are encoded by the library, many in one call. Texts with a special
    token's string or rare white space go through the library whole.
    """

    def __init__(self, path: str, remember: int = REMEMBER):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.cuts = self._facts()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        self.special_bytes = re.compile("|".join(special).encode()) if special else None
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {"": b""}
        self.remember = remember

    def _facts(self) -> bool:
        """Whether pieces may be encoded apart: a byte-level splitter and no normaliser."""
        import json
        state = json.loads(self.tokenizer.to_str())
        step = state.get("pre_tokenizer") or {}
        strips = any(t.lstrip or t.rstrip or " " in t.content
                     for t in self.tokenizer.get_added_tokens_decoder().values())
        return (not strips and step.get("type") == "ByteLevel" and not step.get("add_prefix_space")
                and step.get("use_regex", True) and not state.get("normalizer"))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for first in range(0, len(texts), CALL)
                for e in self.tokenizer.encode_batch_fast(texts[first:first + CALL], add_special_tokens=False)]

    def _whole(self, text: str) -> bytes:
        """Ids of a text that is not cut at every space; a long one is cut at some plain spaces, since the
        library holds many bytes per token of a call."""
        spans, first = [], 0
        while len(text) - first > SPAN and (cut := _PLAIN.search(text, first + SPAN)):
            spans.append(text[first:cut.start()])
            first = cut.start()
        spans.append(text[first:])
        return b"".join([self._ids([span])[0] for span in spans])

    def _odd(self, text: str) -> bool:
        """Whether a space may belong to the white space before it, or a special token is there."""
        return (text[-1:] == " " or any(pair in text for pair in _PAIRS) or "\0" in text
                or not text.isascii() and _RARE.search(text) is not None
                or self.special is not None and self.special.search(text) is not None)

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces and of the new words in them. Pieces of common characters are cut on into the
        splitter's own words; most are one word already."""
        known, whole, rest, cut = self.known, [], [], {}
        for p in pieces:
            if p[1:].isalpha() and p[0] == " " and (p.isascii() or _COMMON.fullmatch(p)):
                whole.append(p)
            elif _COMMON.fullmatch(p):
                cut[p] = _SPLIT.findall(p)
            else:
                rest.append(p)
        inner = {w for ws in cut.values() for w in ws if w not in known}
        inner.update(whole)
        out = dict(zip(inner, self._words(list(inner)), strict=True))
        for p, ws in cut.items():
            if len(ws) > 1:
                out[p] = b"".join([out[w] if w in out else known[w] for w in ws])
        if rest:
            out.update(zip(rest, self._ids(rest), strict=True))
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of the splitter, without NUL, from the library's model: it need not split them again."""
        tokenize, flat, ends = self.model.tokenize, [], []
        for word in "\0".join(words).encode().decode("latin-1").translate(_SPELLED).split("\0") if words else []:
            flat += [t.id for t in tokenize(word)]
            ends.append(len(flat))
        ids = np.array(flat, dtype=self.kind)
        raw, size = ids.tobytes(), ids.itemsize
        return [raw[a * size:e * size] for a, e in zip([0, *ends], ends)]

    def _remembered(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words of the splitter."""
        out = list(map(self.known.get, words))
        new = [i for i, ids in enumerate(out) if ids is None]
        fresh = [words[i] for i in new]
        made = self._words(fresh)
        for i, ids in zip(new, made, strict=True):
            out[i] = ids
        self.known.update(islice(zip(fresh, made), max(0, self.remember - len(self.known))))
        return out

    def _plain(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Ids of the texts of a buffer from the places where their words begin."""
        at = np.flatnonzero(starts)
        if not len(at):
            return [b""] * (len(offsets) - 1)
        bounds = np.append(at, len(data))
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        number = words.indices.to_numpy()
        ids = self._remembered(words.dictionary.to_pylist())
        size = np.dtype(self.kind).itemsize
        many = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // size
        where = np.cumsum(many) - many
        flat = np.frombuffer(b"".join(ids), dtype=self.kind)
        counts = many[number]
        ends = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(counts, out=ends[1:])
        raw = flat[np.repeat(where[number] - ends[:-1], counts) + np.arange(ends[-1])].tobytes()
        cuts = (ends[np.searchsorted(at, offsets)] * size).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_utf8(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of the texts whose UTF-8 bytes lie one after another in ``data``, bounded by ``offsets``."""
        if not len(data):
            return [b""] * (len(offsets) - 1)
        if self.cuts:
            starts, odd = _word_starts(data, offsets)
            if self.special_bytes is not None and self.special_bytes.search(data):
                odd |= [self.special_bytes.search(data, a, b) is not None for a, b in zip(offsets, offsets[1:])]
        else:
            starts, odd = None, np.ones(len(offsets) - 1, dtype=bool)
        if not odd.any():
            return self._plain(data, offsets, starts)
        out: list[bytes] = [b""] * len(odd)
        sizes = np.diff(offsets)
        if not odd.all():
            keep = np.repeat(~odd, sizes)
            plain = self._plain(data[keep], np.append(0, np.cumsum(sizes[~odd])), starts[keep])
            for i, ids in zip(np.flatnonzero(~odd).tolist(), plain, strict=True):
                out[i] = ids
        rows, texts, held = np.flatnonzero(odd).tolist(), [], 0
        first = 0
        for n, i in enumerate(rows):
            texts.append(data[offsets[i]:offsets[i + 1]].tobytes().decode())
            held += int(sizes[i])
            if held >= PIECES or n + 1 == len(rows):
                for k, ids in zip(rows[first:n + 1], self._mixed(texts), strict=True):
                    out[k] = ids
                texts, held, first = [], 0, n + 1
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)], dtype=np.int64)
        return self.encode_utf8(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)

    def _mixed(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._ids(texts)
        out: list[bytes] = [b""] * len(texts)
        odd = [i for i, t in enumerate(texts) if self._odd(t)]
        short = [i for i in odd if len(texts[i]) <= SPAN]
        for i, ids in zip(short, self._ids([texts[i] for i in short]), strict=True):
            out[i] = ids
        for i in odd:
            if len(texts[i]) > SPAN:
                out[i] = self._whole(texts[i])
        skip = set(odd)
        split = {i: t.replace(" ", "\0 ").split("\0") for i, t in enumerate(texts) if t and i not in skip}
        new = set()
        for pieces in split.values():
            new.update(pieces)
        known = self.known
        new.discard("")
        fresh = self._learn([p for p in new if p not in known])
        if len(known) + len(fresh) <= self.remember:
            known.update(fresh)
            get = known.__getitem__
        else:
            get = ChainMap(known, fresh).__getitem__ if len(fresh) < 50 else {
                **{p: known[p] for p in new if p in known}, **fresh, "": b""}.__getitem__
            known.update(islice(fresh.items(), max(0, self.remember - len(known))))
        for i, pieces in split.items():
            out[i] = b"".join(map(get, pieces))
        return out


def _encoder(path: str) -> Encoder:
    """One encoder per worker process, kept between its tasks. A task has one core, so the library
    gets no threads of its own, each of which would hold memory."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return textbuf.hold(f"tokens {path}", lambda: Encoder(path))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
                 block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes ``docs`` (doc_id, text) as blocks under ``path`` in ascending doc_id order.

    Text is shuffled once, by ranges of doc_id; encoding follows in the tasks that write.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        size = len(end)
        seq, waiting, names, tokens, part = 0, [], [], 0, 0
        for batch in batches:
            part = batch.column(2)[0].as_py() if len(batch) else part
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for first, stop, data, offsets in textbuf.chunks(texts, CHUNK):
                for name, raw in zip(ids[first:stop], encoder.encode_utf8(data, offsets), strict=True):
                    names.append(name)
                    waiting.append(raw + end)
                    tokens += len(raw) // size + 1
                    if tokens >= block_tokens:
                        yield _block(part, seq, names, waiting, size)
                        seq, waiting, names, tokens = seq + 1, [], [], 0
        if names:
            yield _block(part, seq, names, waiting, size)

    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(
        F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ranged.withColumn("part", F.spark_partition_id()).mapInArrow(run, BLOCK_SCHEMA).write.parquet(path)


def _block(part: int, seq: int, names: list[int], texts: list[bytes], size: int) -> pa.RecordBatch:
    ends = np.cumsum(np.array([len(t) // size for t in texts], dtype=np.int64))
    ef = EliasFano.build(ends)
    columns = [[part], [seq], [len(names)], [int(ends[-1])], [size], [ef.low_bits], [names],
               [ef.low], [ef.high], [ef.samples.tobytes()], [b"".join(texts)]]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()),
             pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      [f.split()[0] for f in BLOCK_SCHEMA.split(", ")])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``base``: how many ids come before each in the whole data set.

    Ids are counted per part first, so no task sees more than one part's blocks or one row
    per part.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = freeze(blocks.select("part", "seq", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("_own"))
                   .join(parts, "part").select("part", "seq", (F.col("_base") + F.col("_own")).alias("base")),
                   "token-bases")
    return blocks.join(bases, ["part", "seq"])


def _boundaries(block: dict) -> EliasFano:
    return EliasFano(block["docs"], block["low_bits"], block["low"], block["high"], block["samples"])


def _documents(block: dict, names: list[int], starts: np.ndarray, ends: np.ndarray,
               fields: str) -> pa.RecordBatch:
    """Documents of one block that begin and end at the given ids of it, as the columns ``fields``."""
    ids = np.frombuffer(block["ids"], dtype=f"<u{block['id_bytes']}")
    texts = [ids[a:e].astype("<u4") for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    out = [pa.array(names, pa.int64()), pa.array(starts + block["base"], pa.int64()),
           pa.array(ends - starts, pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64())]
    if fields.endswith("array<long>"):
        out.append(pa.array(texts, pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(out, [f.split()[0] for f in fields.split(", ")])


def _fields(with_ids: bool) -> str:
    return "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document, from the files alone.

    A block's boundaries are selected for ``READ_RUN`` documents at a time, so no table of all
    its boundaries is built.
    """
    fields = _fields(with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ef, start = _boundaries(b), 0
                for first in range(0, ef.count, READ_RUN):
                    ends = ef.range(first, min(first + READ_RUN, ef.count))
                    names = b["doc_ids"][first:first + len(ends)]
                    yield _documents(b, names, np.concatenate([[start], ends[:-1]]), ends, fields)
                    start = int(ends[-1])
    return read_blocks(spark, path).mapInArrow(run, fields)


def fetch_documents(spark: SparkSession, path: str, wanted: DataFrame, with_ids: bool = True) -> DataFrame:
    """As :func:`read_documents`, for the documents whose id is in ``wanted`` (doc_id).

    The ids alone find the blocks and places; a document at place i then lies between ``select(i - 1)``
    and ``select(i)``. Rows that share an asked id all come, repeated and unknown ids change
    nothing, NULL is never asked for.
    """
    fields = _fields(with_ids)
    blocks = read_blocks(spark, path)
    named = blocks.select("part", "seq", F.posexplode("doc_ids").alias("_place", "doc_id"))
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    places = named.join(asked, "doc_id").groupBy("part", "seq").agg(
        F.sort_array(F.collect_list("_place")).alias("_places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ef, at = _boundaries(b), b["_places"]
                starts = np.array([ef.select(i - 1) if i else 0 for i in at], dtype=np.int64)
                ends = np.array([ef.select(i) for i in at], dtype=np.int64)
                yield _documents(b, [b["doc_ids"][i] for i in at], starts, ends, fields)
    return blocks.join(places, ["part", "seq"]).mapInArrow(run, fields)


def encode_and_read(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the data set (to ``path``, else the shared folder) and reads it back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_documents(docs.sparkSession, path)
