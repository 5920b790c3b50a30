"""A part of the registered queries against their SQL; check_oracles.py runs all of them."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.01"
QUICK = [
    "filter_then_aggregate", "filter_accounting", "narrowing_plan", "count_analysis", "robust_statistics",
    "describe_numeric", "describe_categorical", "column_profile", "semantic_types", "histogram", "quality_scores",
    "consistency_findings", "missing_forward_fill", "spearman", "kendall", "chi_square", "anova", "levene", "kruskal",
    "mann_whitney_pairs", "benjamini_hochberg", "group_comparison", "association_rules", "outlier_rows",
    "rule_anomalies", "series_anomalies", "resample_w", "trend_analysis", "series_patterns", "bottlenecks",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_ORACLES") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), entry.oracle_sql()[name], con) == ""


def test_entry_has_rows_and_every_sql_has_a_query(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
