"""Every registered query beside its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entries
from fanfold.plans import registry
from fanfold.plans.fixtures import BASE_TABLES
from tools.check import canonical

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = dict(registry.QUERIES), dict(registry.ORACLES)  # the text operators have tests of their own
# The smallest tables do not reach these selections; the next larger ones do.
LARGER, NEEDS_MORE = "/root/testdata/sf0.01", {
    "c4_run_dirs", "c5_glob", "c6_patterns", "c7_pruned", "c16_plan", "flagship", "v7_alerts", "v8_budget", "j4_experiment", "j8_limit",
    "j17_run", "l1_filter", "l1_job", "l4_execution", "v3_ratio", "k4_suggest", "l5_fresh", "l12_orchestrator", "l1_task", "s1_manifest",
    "c15_patterns"}


@pytest.fixture(scope="module")
def duck():
    found = {}
    for folder in (FOLDER, LARGER):
        found[folder] = duckdb.connect()
        for table in BASE_TABLES:
            found[folder].execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return found


def test_every_query_without_sql_is_known():
    # A sketch has no exact counterpart; r2_bound checks its ranks.
    assert set(QUERIES) - set(ORACLES) == {"r2_approx"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    folder = LARGER if name in NEEDS_MORE else FOLDER
    frame = entries.queries()[name](spark, folder)
    found = duck[folder].execute(ORACLES[name])
    theirs = canonical([d[0] for d in found.description], found.fetchall())
    ours = canonical(frame.columns, frame.collect())
    assert ours == theirs
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ours[1]


def test_entry(spark):
    assert entries.entry(spark).columns == ["exp_id", "run_id", "n_runs", "completeness"]
