"""Every named query against its SQL in DuckDB; queries without SQL must give rows and a stable schema."""

import pytest
from compare import differences, duck
from paths import DATA

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()
# Training is covered by test_modeling on small frames.
SLOW = {"train_classifiers", "train_all_classifiers", "train_regressors", "feature_importances", "prediction_summary", "evaluate_best"}


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_agrees_with_sql(spark, con, name):
    assert differences(QUERIES[name](spark, DATA), con, SQL[name]) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and n not in SLOW])
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


ORDERED = [
    "running_total_per_customer", "ntile_by_balance", "event_gaps", "time_halves", "sorted_quantiles", "forward_fill", "backward_fill_per_user",
    "trend", "drift", "rank_correlation", "ranks_per_region", "at_most_three_above", "stratified_split", "group_split", "time_folds", "oversample",
    "roc_auc", "roc_auc_one_vs_rest", "version_changes", "cache_entries", "validate_split", "continuity",
]


@pytest.mark.parametrize("name", ORDERED)
def test_agrees_over_many_slices(spark, con, name):
    """Small slices are normally joined; kept apart, every total has to cross them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert differences(QUERIES[name](spark, DATA), con, SQL[name]) == []
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
