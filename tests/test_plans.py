"""Plan shapes that the design depends on (checked on the optimized physical plan)."""

import pytest

from riskbands.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


METRICS = ["fraud_cost_current", "fraud_cost_new", "twofa_cost_new", "revenue_current", "revenue_new",
           "approval_current", "approval_new", "false_positive_current", "false_positive_new",
           "false_negative_current", "false_negative_new", "fraud_by_device_accounts"]


@pytest.mark.parametrize("name", METRICS)
def test_no_expand_for_distinct_counts(spark, name):
    assert "Expand" not in plan(spark, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_or_nested_loop_join(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_device_history_windows_are_sliced(spark):
    p = plan(spark, "accounts_per_device_history")
    windows = [line for line in p.splitlines() if "Window [" in line]
    assert len(windows) == 2
    # one window per (device, slice), one per device over slice totals; none over raw rows
    assert any("device_id" in w and "bucket" in w and "transaction_timestamp" in w for w in windows)
    assert any("sum(n" in w for w in windows)


def test_null_ids_skip_the_id_joins(spark):
    p = plan(spark, "risk_bands")
    assert "isnotnull(transaction_id" in p and "isnull(transaction_id" in p


def test_flag_profile_is_one_scan(spark):
    assert plan(spark, "flag_profile").count("FileScan") == 1


def test_filters_reach_the_scan(spark):
    p = plan(spark, "rule_far_distance")
    assert "PushedFilters: [IsNotNull(distance_to_frequent_location), GreaterThan(distance_to_frequent_location" in p


def test_threshold_uses_map_side_group_limit(spark):
    p = plan(spark, "high_risk_band")
    assert "WindowGroupLimit" in p and ", Partial" in p
