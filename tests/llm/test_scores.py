"""Quality and toxicity: held-out accuracy, restoration, and awkward rows."""

import random

import numpy as np
import pytest
from fixtures import MESSY, documents, empty, labels, messy
from pyspark.sql import functions as F

from leadloom.llm import quality, textbuf, toxicity
from leadloom.llm.common import crc32_of_id

WORDS = "river stone garden winter letter market silver window forest summer village morning paper kitchen".split()
BAD = "grobble snarfed vilethin".split()

def learn():
    return F.coalesce(crc32_of_id() % 5 != 0, F.lit(True))


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    rows, toxic, good = [], [], []
    for i in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(20, 200))]
        bad, junk = i % 6 == 0, i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", ".", "!"]))
        text = " ".join(x + "%%%" if junk and k % 3 else x for k, x in enumerate(w)) + "."
        rows.append((i, text, "s"))
        toxic.append((i, int(bad)))
        good.append((i, int(not junk)))
    return rows, toxic, good


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows, toxic, _ = corpus()
    docs = documents(spark, rows).repartition(3)
    return docs, dict(toxic), toxicity.train(docs, labels(spark, toxic, "toxic"), learn())


def test_toxicity_of_held_out_documents(toxic_model):
    docs, truth, model = toxic_model
    got = toxicity.score_toxicity(docs, model).where(~learn()).collect()
    assert len(got) > 60
    assert all((r.toxicity >= 0.5) == bool(truth[r.doc_id]) for r in got)


@pytest.mark.parametrize("text", ["gr0bble", "GROBBLE", "s n a r f e d", "snaaaarfed", "v1l3th1n", "gr.o.bble",
                                  "$narfed", "snarf3d!!"])
def test_hidden_words_are_read(spark, toxic_model, text):
    _, _, model = toxic_model
    docs = documents(spark, [(1, f"river stone {text} garden winter, {text} letter", "s"), (2, "river stone", "s")])
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, model).collect()}
    assert got[1] > got[2] and got[1] >= 0.5


def test_restored_letters(toxic_model):
    restore = toxicity.Restorer(toxic_model[2].language)
    assert restore(b"r1v3r") == b"river" and restore(b"w.i.n.t.e.r") == b"winter"
    assert restore(b"summmmer") == b"summer"


def test_language_model_counts_all_texts(spark):
    docs = documents(spark, [(1, "ab", "s"), (2, None, "s"), (3, "ab ab", "s"), (4, "", "s")])
    model = np.exp(toxicity.language_model(docs))
    assert model.shape == (28, 28, 28) and model[2, 0, 1] == pytest.approx(1.1 / (3 + 2.8))
    assert model[0, 0, 1] / model[0, 0, 2] == pytest.approx(2.1 / 0.1)
    assert model[1, 2].argmax() == 0


def test_toxicity_awkward_rows(spark, toxic_model):
    _, _, model = toxic_model
    docs = messy(spark)
    got = toxicity.score_toxicity(docs, model, "toxicity_score")
    assert got.columns == [*docs.columns, "toxicity_score"]
    rows = got.collect()
    assert len(rows) == len(MESSY) and all(0 <= r.toxicity_score < 0.5 for r in rows)
    kept = toxicity.clean_documents(docs, labels(spark, [(4, 0), (8, 1), (9, None), (3, 0), (7, 5)], "toxic"), learn())
    assert kept.columns == docs.columns
    assert toxicity.score_toxicity(empty(spark), model).collect() == []


def test_toxicity_without_labels(spark):
    none = toxicity.train(messy(spark), labels(spark, [(1, None)], "toxic").limit(0), learn())
    assert {r.toxicity for r in toxicity.score_toxicity(messy(spark), none).collect()} == {0.5}


def test_quality_of_held_out_documents(spark):
    rows, _, good = corpus()
    docs, truth = documents(spark, rows).repartition(3), dict(good)
    got = quality.score_quality(docs, labels(spark, good, "quality"), learn()).where(~learn()).collect()
    assert np.mean([(r.score >= 0.5) == bool(truth[r.doc_id]) for r in got]) > 0.98


def test_quality_awkward_rows(spark):
    marks = labels(spark, [(4, 1), (8, 0), (3, 1), (7, 0), (5, 1), (9, None), (10, 9), (4, 1)], "quality")
    got = quality.score_quality(messy(spark), marks, learn()).collect()
    assert len(got) == len(MESSY) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(empty(spark), marks, learn()).collect() == []
    alone = quality.score_quality(messy(spark), labels(spark, [(4, 1)], "quality"), learn()).collect()
    assert {r.score for r in alone} == {1.0}
    none = quality.score_quality(messy(spark), marks.limit(0), learn()).collect()
    assert {r.score for r in none} == {0.5}


def test_discriminant_equals_the_textbook_density():
    rng = np.random.default_rng(1)
    cov = [np.array([[2.0, 0.3], [0.3, 1.0]]), np.array([[1.0, -0.2], [-0.2, 0.5]])]
    mean = [np.zeros(2), np.array([1.0, 2.0])]
    factors = [np.linalg.cholesky(c) for c in cov]
    model = quality.Discriminant(tuple(mean), tuple(map(np.linalg.inv, factors)),
                                 tuple(float(np.log(p) - np.log(np.diag(f)).sum())
                                       for p, f in zip((0.3, 0.7), factors, strict=True)), 0.7)
    x = rng.normal(size=(50, 2))
    dens = [p * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(c))
            for p, m, c in zip((0.3, 0.7), mean, cov, strict=True)]
    assert np.allclose(model.score(x), dens[1] / (dens[0] + dens[1]))


def test_words_of_a_buffer():
    import pyarrow as pa
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \t\né.") for _ in range(rng.randrange(30))) for _ in range(200)] + ["", None, " "]
    got = []
    for _, _, data, offsets in textbuf.chunks(pa.array(texts), limit=100):
        start, end, begin = textbuf.words(data, offsets)
        raw = data.tobytes()
        got += [[raw[start[k]:end[k]] for k in range(begin[d], begin[d + 1])] for d in range(len(offsets) - 1)]
    assert got == [(t or "").encode().split() for t in texts]
