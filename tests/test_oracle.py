"""Every registered query against its oracle SQL."""

import pytest

import __spark_entry__ as entry_module
from compare import diff, oracle

from leadloom.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(data_dir):
    return oracle(data_dir)


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLE)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLE) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, data_dir, con, name):
    assert diff(QUERIES[name](spark, data_dir), con, ORACLE[name]) is None


def test_entry(spark, data_dir):
    rows = entry_module.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, 21))
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
