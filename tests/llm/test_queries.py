"""The registered queries: names, whole tables, and oracle SQL where there is any."""

import pytest
from compare import diff, oracle

import __spark_entry__ as entry_module
from leadloom.llm.queries import ORACLE, QUERIES


NOT_BY_DOCUMENT = ("op2", "op8", "op12", "op13")


def test_all_are_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry_module.queries())
    assert set(ORACLE) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, data_dir, name):
    assert diff(QUERIES[name](spark, data_dir), oracle(data_dir), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if q.split("_")[0] not in NOT_BY_DOCUMENT))
def test_one_row_per_document(spark, data_dir, name):
    rows = QUERIES[name](spark, data_dir).select("doc_id").collect()
    ids = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in ids)
