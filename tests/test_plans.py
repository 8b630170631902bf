"""Plans: no products, filters and columns reach the scan, limits come before vectors."""

import pytest

import __spark_entry__ as entry
from conftest import SMALL

QUERIES = entry.queries()


def plan(spark, name):
    df = QUERIES[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j5_point_in_polygon", "j6_covered", "j7_nearest", "j13_target_pairs", "r2_select_by_content",
                                  "r6_mask_by_country", "a20_soft_targets", "w9_weighted_resample", "j12_geocode_first_hit"])
def test_no_products(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_point_lookup_is_pushed(spark):
    text = plan(spark, "f11_by_id")
    assert "EqualTo(o_orderkey,77)" in text and "o_custkey" not in text


def test_caps_limit_below_the_exchange(spark):
    text = plan(spark, "w5_cap_per_group")
    assert text.count("WindowGroupLimit") >= 1


@pytest.mark.parametrize("name", ["l2_head_n", "w7_sample_n"])
def test_first_rows_are_not_merged_in_one_task(spark, name):
    text = plan(spark, name)
    assert "TakeOrderedAndProject" not in text and "CollectLimit" not in text and "GlobalLimit" not in text


def test_cell_statistics_have_one_wide_exchange(spark):
    text = plan(spark, "a1_cell_stats")
    assert text.count("hashpartitioning(level") == 1
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
