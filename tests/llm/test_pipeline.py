"""The pipeline on small tables, every stage against a plain version of its rule."""

from collections import Counter

import pytest
from fixtures import COLUMNS, documents, labels, prose
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.session import scratch_path

BAD = "grobble snarfed vilethin".split()


@pytest.fixture(scope="module")
def sf_dir(spark):
    base = scratch_path(spark, "pipeline-test")
    rows = [(i, prose(i, 60 + i % 50), f"s{i % 4}") for i in range(120)]
    toxic = [(i, f"{prose(i, 40)} {BAD[i % 3]} {BAD[(i + 1) % 3]} {prose(i + 7, 9)}", "s1") for i in range(200, 260)]
    copies = [(300 + i, rows[0][1], "hot") for i in range(30)]
    near = [(400 + i, rows[1][1] + f" extra{i}", "hot") for i in range(20)]
    item = prose(9000, 40)
    leaked = [(500 + i, f"{prose(600 + i, 30)} {item} {prose(700 + i, 30)}", "s2") for i in range(10)]
    odd = [(800, None, None), (801, "", "s0"), (None, prose(3000, 50), "s3"), (802, prose(3001, 50), None)]
    documents(spark, rows + toxic + copies + near + leaked + odd).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    marks = [(i, 0) for i in range(120)] + [(i, 1) for i in range(200, 260)]
    labels(spark, marks, "toxic").write.parquet(f"{base}/labels.parquet")
    return base


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {None: None}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        path = scratch_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())
    ids = set(kept["toxicity"])
    assert ids == set(range(120)) | {*range(300, 330), *range(400, 420), *range(500, 510), 800, 801, 802, None}
    assert set(kept["near_dedup"]) == ids - set(range(300, 330)) - set(range(400, 420))
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - set(range(500, 510))
    assert all(n == 1 for n in kept["decontamination"].values())
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and max(kept["mixing"].values()) <= 3
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert Counter(r.doc_id for r in tokens.collect()) == kept["mixing"]


def test_run_and_empty(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    base = scratch_path(spark, "pipeline-empty")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{base}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where(F.lit(False)).write.parquet(f"{base}/{name}.parquet")
    assert corpus_pipeline.run(spark, base).collect() == []
