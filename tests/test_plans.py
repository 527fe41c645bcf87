"""Physical plans: no pairwise joins, pushed filters, narrow scans, early combining."""

import pytest

from leadloom.operators import filters as P
from leadloom.plans.catalog import QUERIES
from leadloom.plans.views import Views

# pages whose markup nests are parsed as a tree
PARSED = ("extract_cards_nested", "extract_table_rows", "extract_text", "scrape_union")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_join_and_no_python(spark, data_dir, name):
    plan = plan_of(QUERIES[name](spark, data_dir))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in PARSED:
        assert "Python" not in plan and "InPandas" not in plan


def test_filters_reach_the_scan(spark, data_dir):
    v = Views(spark, data_dir)
    day = plan_of(P.events_on_day(v.log(), "2024-01-15"))
    assert "PushedFilters" in day and "GreaterThanOrEqual(ts" in day and "LessThan(ts" in day
    assert "GreaterThanOrEqual(ts" in plan_of(P.fresh(v.log(), "created_at", 4, "2024-01-15 00:00:00"))
    assert "In(p_size, [3,4])" in plan_of(P.level_filter(v.table("part"), "p_size"))


def test_columns_are_pruned(spark, data_dir):
    plan = plan_of(QUERIES["dashboard_stats"](spark, data_dir))
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


@pytest.mark.parametrize("name, mark", [
    ("latest_doc", "partial_max"), ("draft_documents", "partial_max"),
    ("fallback_enrich", "partial_min"), ("needs_regen", "HashAggregate"),
    ("cap_per_group", "WindowGroupLimit"), ("topk_scored", "TakeOrderedAndProject"),
    ("recent_emails", "TakeOrderedAndProject")])
def test_rows_shrink_before_the_shuffle(spark, data_dir, name, mark):
    assert mark in plan_of(QUERIES[name](spark, data_dir))
