"""Registered queries against their checking SQL on the smallest tables.

`python -m tests.oracle` compares all of them at a larger scale.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connection

FOLDER = "/root/testdata/sf0.001"
SHORT = ["column_profile_part", "column_profile_missing", "duplicate_rows", "quantiles", "date_number_probe", "pick_target_events",
         "outliers_modified_z", "spearman_missing", "cramers_v_orders", "anova_f", "column_pairs", "class_balance", "vif_three", "impute_median",
         "pca_variance_two", "f_classif", "histogram", "kde_curve_events", "violin_summary", "grouped_counts", "findings_profile", "merge_turns",
         "recommendations", "retry_queue", "scan_csv", "scan_arrow", "sample_rows", "row_digests", "knn_graph",
         "scan_csv_long_ids", "sample_rows_repeated", "table_fingerprint_missing", "histogram_far_values"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SHORT


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    verdict, rows = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], con, FOLDER)
    assert verdict == "ok"


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 11


@pytest.mark.parametrize("name", ["column_profile_lineitem", "cramers_v", "correlation_ratio", "histogram", "grouped_counts", "class_balance",
                                  "merge_turns", "kde_curve", "column_pairs", "spearman_part", "chi2_feature"])
def test_no_query_multiplies_tables(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
