"""Token files: exact round trip against the tokenizers library, and the boundary structure."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import MESSY, documents, empty, messy, prose
from tokenizers import Tokenizer

from leadloom.llm import tokens
from leadloom.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "it's 12,5 %\t\tx", "é ü\u00a0x \u3000y", "a\0b c",
       "word<|endoftext|>word", "don't  stop!!  ", "\r\n\r\n", "x\u2028y z", "混ぜる テスト", "\U0001f600\U0001f600 ok"]


def check(rows, got):
    plain = Tokenizer.from_file(PATH)
    by_id, start = {}, 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    for i, t, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        by_id.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in by_id.items()}


def test_messy_rows(spark):
    check(MESSY, tokens.encode_and_read(messy(spark), PATH).collect())


def test_odd_white_space_and_small_blocks(spark):
    rows = [(k, t, "s") for k, t in enumerate(ODD)] + [(100 + k, prose(k, 30 + k), "s") for k in range(50)]
    path = scratch_path(spark, "tokens-test")
    tokens.write_tokens(documents(spark, rows).repartition(5), path, PATH, block_tokens=500)
    assert spark.read.parquet(path).count() > 5
    got = tokens.read_documents(spark, path, with_ids=True).collect()
    check(rows, got)
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 0 for r in got)
    asked = spark.createDataFrame([(k,) for k in (0, 3, 3, 7, 120, 149, -1, None)], "doc_id long")
    fetched = tokens.fetch_documents(spark, path, asked).collect()
    assert sorted(fetched) == sorted(r for r in got if r.doc_id in (0, 3, 7, 120, 149))


def test_boundaries_are_read_in_runs(spark, monkeypatch):
    monkeypatch.setattr(tokens, "READ_RUN", 3)
    rows = [(k // 2, prose(k, k % 7), "s") for k in range(40)]
    path = scratch_path(spark, "tokens-test")
    tokens.write_tokens(documents(spark, rows), path, PATH)
    got = tokens.read_documents(spark, path).collect()
    check(rows, got)
    asked = spark.createDataFrame([(4,), (19,)], "doc_id long")
    fetched = tokens.fetch_documents(spark, path, asked, with_ids=False).collect()
    assert sorted(fetched) == sorted(r for r in got if r.doc_id in (4, 19)) and len(fetched) == 4


def test_empty(spark):
    assert tokens.encode_and_read(empty(spark), PATH).collect() == []


@pytest.mark.parametrize("remember", [0, 3, 10_000])
def test_memory_of_the_encoder_does_not_matter(remember):
    encoder, plain = tokens.Encoder(PATH, remember), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" a\n'éx1.!") for _ in range(60)) for _ in range(300)]
    for _ in range(2):
        got = [np.frombuffer(b, dtype="<u2").tolist() for b in encoder.encode(texts)]
        assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("call", "span"), [(1, 5), (3, 40), (7, 1000)])
def test_size_of_library_calls_does_not_matter(monkeypatch, call, span):
    monkeypatch.setattr(tokens, "CALL", call)
    monkeypatch.setattr(tokens, "SPAN", span)
    encoder, plain = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("  ab1\n'é.\u00a0") for _ in range(200)) for _ in range(200)]
    texts.append("one two  three <|endoftext|> four\n five\u2028six 7 eight " * 100)
    got = [np.frombuffer(b, dtype="<u2").tolist() for b in encoder.encode(texts)]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_an_encoder_keeps_a_bounded_amount_of_memory(monkeypatch):
    monkeypatch.setattr(tokens.Encoder, "_learn", lambda self, pieces: {p: p[-6:].encode() for p in pieces})
    encoder = tokens.Encoder(PATH)
    tracemalloc.start()
    for first in range(0, 900_000, 30_000):
        encoder.encode(["".join(f" word{k:06d}" for k in range(first, first + 30_000))])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 70e6


def test_common_texts_are_cut_into_words_and_each_goes_through_the_model_once(monkeypatch):
    encoder, plain, seen = tokens.Encoder(PATH), Tokenizer.from_file(PATH), []
    words = encoder._words
    monkeypatch.setattr(encoder, "_words", lambda new: seen.extend(new) or words(new))
    texts = ["one, two", "Two two! (two) two's", "\n\nd\u00e9j\u00e0\u00d72 two?", "two two! it've'", "", "'s two"]
    for _ in range(2):
        got = [np.frombuffer(b, dtype="<u2").tolist() for b in encoder.encode(texts)]
        assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert sorted(seen) == sorted({w for t in texts for w in tokens._SPLIT.findall(t)})


def test_words_of_every_character_equal_the_library():
    encoder, plain, rng = tokens.Encoder(PATH), Tokenizer.from_file(PATH), random.Random(5)
    texts = [f"a{c}b 1{c}2 !{c}! {c} x{c}\n'{c} '{c}" for c in map(chr, range(1, 0x800))]
    for letters in (" a\n'\u00e9x1.!\u00d7_", "'stmdrelv ", "\n\t\r a'", "a\u00e9\u4e2d ' \n1\u0250\u00f7"):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    got = [np.frombuffer(b, dtype="<u2").tolist() for b in encoder.encode(texts)]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("steps", [[1], [1, 1, 1], [5, 1, 100_000, 2], [3] * 1000, [1, 2, 9, 400] * 300, [2**33, 1]])
def test_elias_fano(steps):
    ends = np.cumsum(np.array(steps, dtype=np.int64))
    ef = tokens.EliasFano.build(ends)
    assert ef.all().tolist() == ends.tolist()
    assert [ef.select(i) for i in range(len(ends))] == ends.tolist()
    for first, stop in [(0, 1), (1, len(ends)), (len(ends) // 3, len(ends) // 2), (255, 258), (256, 600)]:
        stop = min(stop, len(ends))
        assert ef.range(first, stop).tolist() == ends[first:stop].tolist()
    bits = 8 * (len(ef.low) + len(ef.high))
    assert bits <= len(ends) * (3 + max(0.0, np.log2(ends[-1] / len(ends)))) + 16
