"""Every query with SQL against DuckDB, at the smallest scale."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from casebook.plans.catalog import QUERIES
from casebook.plans.oracle import SQL


# Whole cascades take a minute each; TEST_SLOW=1 runs these too. test_models has the same checks.
SLOW = {
    "cascade_vectors", "alt_grouping_checks", "cascade_confusion_checks", "level2_cascade_checks",
    "cascade_sweep_checks", "issue_cascade_checks", "grid_search_checks",
}


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(set(SQL) - (set() if os.environ.get("TEST_SLOW") else SLOW)))
def test_query(spark, folder, con, name):
    assert difference(spark, con, folder, QUERIES[name], SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_but_the_models_has_sql():
    models = {
        "level1_lr", "level1_svc_calibrated", "grid_search", "out_of_fold", "level2_cascade",
        "cascade_sweep", "issue_cascade", "alt_grouping", "run_summary", "cascade_report",
        "cascade_pairs",
    }
    assert set(QUERIES) - set(SQL) == models
