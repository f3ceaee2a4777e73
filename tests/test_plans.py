"""Plans: no one-task window over rows, no Python where Spark has the expression, pruned and filtered scans."""

import re

import pytest
from paths import DATA

from __spark_entry__ import queries

QUERIES = queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON_IS_FINE = {"standard_categories", "trend", "drift"}


@pytest.mark.parametrize("name", ["running_total_by_day", "forward_fill", "time_split", "stratified_folds", "roc_auc", "two_sample_distance", "cache_entries", "ntile_by_balance", "hash_encoding", "clean_text", "answer_scores", "lint_sql"])
def test_stays_in_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "Python" not in text and "ArrowEval" not in text


@pytest.mark.parametrize("name", ["running_total_per_customer", "backward_fill_per_user", "time_folds"])
def test_row_windows_are_partitioned_by_slice(spark, name):
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan(QUERIES[name](spark, DATA)))
    assert windows and any("__slice" in w for w in windows)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["region_filter_projection"](spark, DATA))
    assert "EqualTo(r_name,EUROPE)" in text
    lines = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any("l_extendedprice" in s and "l_shipdate" not in s for s in lines)


def test_profile_is_one_scan(spark):
    assert plan(QUERIES["missing_report"](spark, DATA)).count("FileScan") == 1


def test_top_per_group_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["top_brands_per_region"](spark, DATA))
