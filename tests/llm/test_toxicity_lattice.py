"""Toxicity: readings of the lattice, against words marked by hand. No Spark needed."""

import random

import numpy as np
import pyarrow as pa
import pytest

from leadloom.llm import textbuf, toxicity

PLAIN = ("you are a river stone garden winter letter market silver window forest summer village morning paper "
         "kitchen the of and that is was with from boot book trip race over").split()
MARKED = "loser moron idiot trash worthless".split()


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    text = " ".join(rng.choice(PLAIN * 3 + MARKED) for _ in range(20_000)).encode()
    s = np.concatenate([[0, 0], toxicity._SYMBOL[np.frombuffer(text, dtype=np.uint8)]])
    cube = np.bincount(s[:-2] * 784 + s[1:-1] * 28 + s[2:], minlength=28 ** 3).reshape(28, 28, 28) + 0.1
    data = np.frombuffer("".join(MARKED).encode(), dtype=np.uint8)
    end = np.cumsum([len(w) for w in MARKED])
    keys = np.sort(textbuf.word_hashes(data, np.concatenate([[0], end[:-1]]), end))
    return toxicity.ToxicityModel(np.log(cube / cube.sum(axis=2, keepdims=True)), keys, np.ones(len(keys)), 1.0, 0.0)


def marked(model, *texts):
    (_, _, data, offsets), = textbuf.chunks(pa.array(texts))
    return model.evidence(data, offsets, toxicity.Restorer(model.language)).tolist()


@pytest.mark.parametrize("text", ["a l o s e r", "l o s e r", "i d ! o t", "m 0 r 0 n", "t r @ s h", "lo ser", "mor on", "wo rth less",
                                  "the i d i o t of", "i. d. i. o. t.", "l0 ser", "tr ash", "you are a l o s e r and"])
def test_spacing_is_part_of_the_lattice(model, text):
    assert marked(model, f"river stone {text} winter", "river stone winter") == [1, 0]


def test_spaces_do_not_join_texts(model):
    assert marked(model, "lo", "ser", "l", "o s e r", "a b 1 2 3 4") == [0] * 5
    assert marked(model, "", "stone lo", "ser winter", "loser", "mor on") == [0, 0, 0, 1, 1]


@pytest.mark.parametrize("text", ["mmoorroonn", "looser", "!diot", "|oser", "+rash", "(!diot)", "1d10t!", "loseer,"])
def test_doubled_letters_and_signs_at_an_edge(model, text):
    assert marked(model, f"river stone {text} winter", "river book, letter! +summer winter") == [1, 0]


@pytest.mark.parametrize("text", ["l" + "o" * 70 + "ser", "m" + "0" * 90 + "ron", "l" + "." * 100 + "oser",
                                  ".".join("youarealoserandthatisthewinterofthegarden"), ".".join("theriver" * 9 + "moron")])
def test_long_words_are_read(model, text):
    assert marked(model, f"river stone {text} winter") == [1]


def test_long_words_take_linear_time(model):
    restore = toxicity.Restorer(model.language)
    letters = "theriverofthegarden" * 5000
    assert restore(letters.encode() + b"1").startswith(b"theriverof")
    assert restore(".".join(letters).encode()).replace(b" ", b"").startswith(b"theriverof")
