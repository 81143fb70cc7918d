"""Task-set, run and gather queries."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanfold.operators import tasks as K
from fanfold.operators import telemetry as M
from fanfold.plans.registry import Inputs, query
from fanfold.session import shared_dir

GRID = {"beta": [0.2, 0.3, 0.4], "gamma": [0.1, 0.2]}
LHS = {"beta": (0.1, 0.5), "gamma": (0.05, 0.25)}
MIXED = ("CASE WHEN run_key % 50 = 0 AND task_index = 0 THEN 'CalibrationOutput' "
         "WHEN run_key % 3 = 0 THEN 'CalibrationOutput' ELSE 'SimulationOutput' END")


def results(t: Inputs) -> DataFrame:
    return t.fx("fx_results").select("run_key", "task_index", "status")


def runs(t: Inputs) -> DataFrame:
    return t.fx("fx_runs")


GATHER_SQL = """
SELECT run_key, n_expected, n_ok, n_failed, n_expected - n_ok - n_failed AS n_missing FROM (
  SELECT r.run_key, any_value(n_expected) AS n_expected,
    count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'failed') AS n_failed
  FROM fx_runs r LEFT JOIN fx_results s ON r.run_key = s.run_key GROUP BY r.run_key)"""


@query("t1_grid", """
SELECT c_custkey, c_nationkey, beta, gamma FROM customer, (VALUES (0.2::double), (0.3), (0.4)) b(beta),
  (VALUES (0.1::double), (0.2)) g(gamma)
""")
def t1_grid(t: Inputs) -> DataFrame:
    return K.task_grid(t.customer.select("c_custkey", "c_nationkey"), **GRID)


@query("t2_lhs", "WITH ranked AS (SELECT c_custkey, count(*) OVER () AS n, " + ", ".join(
    f"row_number() OVER (ORDER BY md5('7/{d}/' || c_custkey), c_custkey) - 1 AS {d}_stratum" for d in LHS)
    + " FROM customer) SELECT c_custkey, " + ", ".join(
    f"{d}_stratum, {low} + ({d}_stratum + 0.5::double) / n * ({high} - {low}) AS {d}" for d, (low, high) in LHS.items()) + " FROM ranked")
def t2_lhs(t: Inputs) -> DataFrame:
    return K.task_lhs(t.customer.select("c_custkey"), "c_custkey", LHS, seed=7)


# Each range must be cut into strata that are used once each.
@query("t2_strata", """
SELECT 'beta' AS dimension, count(*) AS n, count(*) AS n_strata, 0::bigint AS low, count(*) - 1 AS high FROM customer
UNION ALL SELECT 'gamma', count(*), count(*), 0, count(*) - 1 FROM customer
""")
def t2_strata(t: Inputs) -> DataFrame:
    design = t2_lhs(t)
    strata = design.select(F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(f"{d}_stratum").alias("stratum")) for d in LHS])))
    cells = strata.groupBy("dimension", "stratum").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("dimension").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_strata"), F.min("stratum").alias("low"),
        F.max("stratum").alias("high"))


@query("t3_index", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS task_index,
  printf('input_%05d.pkl.gz', row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS task_file FROM orders
""")
def t3_index(t: Inputs) -> DataFrame:
    return K.index_tasks(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("t4_budget", """
SELECT run_key, count(*) AS n_tasks, least(count(*), 3) AS parallelism, ceil(count(*) / least(count(*), 3))::bigint AS waves
FROM fx_results GROUP BY run_key
""", "fx_results")
def t4_budget(t: Inputs) -> DataFrame:
    return K.task_budget(K.require_tasks(results(t)), max_parallelism=3)


def growth(workload: dict) -> pd.DataFrame:
    """A stand-in for a user's model: five steps of compound growth; refuses negative rates."""
    if workload["rate"] < 0:
        raise ValueError("negative rate")
    steps = range(5)
    return pd.DataFrame({"step": steps, "value": [workload["start"] * (1 + workload["rate"]) ** s for s in steps]})


@query("t6_run", """
SELECT c_custkey AS task_index, 'ok' AS status, '' AS error_type, '' AS error_message, step,
  round((c_custkey % 100 + 1) * pow(1 + c_acctbal / 100000, step), 8) AS value
FROM customer, (SELECT unnest(range(5)) AS step) WHERE c_acctbal >= 0
UNION ALL SELECT c_custkey, 'failed', 'ValueError', 'negative rate', -1, -1 FROM customer WHERE c_acctbal < 0
""")
def t6_run(t: Inputs) -> DataFrame:
    tasks = t.customer.select(F.col("c_custkey").alias("task_index"), (F.col("c_custkey") % 100 + 1).alias("start"),
                              (F.col("c_acctbal") / 100000).alias("rate"))
    ran = K.run_tasks(tasks, growth, "step BIGINT, value DOUBLE")
    return (ran.withColumn("value", F.round("value", 8)).na.fill("", ["error_type", "error_message"])
            .na.fill(-1, ["step", "value"]))


@query("t7_gather", GATHER_SQL, "fx_runs", "fx_results")
def t7_gather(t: Inputs) -> DataFrame:
    return K.gather(results(t), runs(t))


@query("t7_gaps", """
WITH expected AS (SELECT run_key, unnest(range(n_expected)) AS task_index FROM fx_runs)
SELECT e.run_key, e.task_index, coalesce(status, 'missing') AS status
FROM expected e LEFT JOIN fx_results s ON e.run_key = s.run_key AND e.task_index = s.task_index
WHERE coalesce(status, 'missing') <> 'ok'
""", "fx_runs", "fx_results")
def t7_gaps(t: Inputs) -> DataFrame:
    return K.gap_tasks(results(t), runs(t))


@query("t8_policy", f"""
SELECT run_key, CASE WHEN n_ok = 0 THEN 'empty' WHEN n_ok < n_expected THEN 'incomplete' ELSE 'ok' END AS verdict
FROM ({GATHER_SQL})
""", "fx_runs", "fx_results")
def t8_policy(t: Inputs) -> DataFrame:
    return K.policy(K.gather(results(t), runs(t)), allow_partial=False).select("run_key", "verdict")


@query("t9_type", f"""
SELECT run_key, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE min(kind) END AS result_type FROM (
  SELECT run_key, CASE WHEN type_name LIKE '%Simulation%' THEN 'simulation' ELSE 'calibration' END AS kind
  FROM (SELECT run_key, {MIXED} AS type_name FROM fx_results)) GROUP BY run_key
""", "fx_results")
def t9_type(t: Inputs) -> DataFrame:
    return K.result_type(t.fx("fx_results").select("run_key", F.expr(MIXED).alias("type_name")))


@query("t11_completeness", f"""
SELECT run_key, n_ok || '/' || n_expected AS completeness, round(n_ok / n_expected, 6) AS ratio FROM ({GATHER_SQL})
""", "fx_runs", "fx_results")
def t11_completeness(t: Inputs) -> DataFrame:
    return K.completeness(results(t), runs(t)).withColumn("ratio", F.round("ratio", 6))


STAGE = "CASE task_index WHEN 0 THEN 'builder' WHEN 6 THEN 'output' ELSE 'runner' END"


@query("m2_summary", f"""
SELECT coalesce(stage, 'total') AS stage, count(*) AS n, count(*) FILTER (status = 'ok') AS n_ok,
  round(sum(duration), 2) AS total_duration, round(avg(duration), 4) AS mean_duration, max(duration) AS max_duration
FROM (SELECT {STAGE} AS stage, status, duration FROM fx_results) GROUP BY ROLLUP (stage)
""", "fx_results")
def m2_summary(t: Inputs) -> DataFrame:
    summary = M.workflow_summary(t.fx("fx_results").select(F.expr(STAGE).alias("stage"), "status", "duration"))
    return summary.withColumns({"total_duration": F.round("total_duration", 2),
                                "mean_duration": F.round("mean_duration", 4)})


@query("m3_text", f"""
SELECT coalesce(stage, 'total') AS stage, printf('%s: %d of %d ok, %.1f s in total, longest %.1f s', coalesce(stage, 'total'),
  count(*) FILTER (status = 'success'), count(*), sum(duration), max(duration)) AS value
FROM (SELECT {STAGE} AS stage, CASE status WHEN 'ok' THEN 'success' ELSE status END AS status, duration FROM fx_results)
GROUP BY ROLLUP (stage)
""", "fx_results")
def m3_text(t: Inputs) -> DataFrame:
    summary = M.workflow_summary(t.fx("fx_results").select(F.expr(STAGE).alias("stage"), F.replace("status", F.lit("ok"), F.lit("success")).alias("status"), "duration"))
    return M.summary_text(summary)


@query("m3_twins", f"""
SELECT unnest(['json', 'txt']) AS kind, count(*) + 1 AS n, sum(n) AS n_tasks FROM (
  SELECT {STAGE} AS stage, count(*) AS n FROM fx_results GROUP BY ALL)
""", "fx_results")
def m3_twins(t: Inputs) -> DataFrame:
    """The summary is written as JSON and as text; both are read back and hold every stage and the total."""
    root = f"{shared_dir(t.spark)}/stored-{uuid.uuid4().hex}"
    M.write_summary(M.workflow_summary(t.fx("fx_results").select(F.expr(STAGE).alias("stage"), "status", "duration")), root, "all")
    stages = t.spark.read.schema("stage STRING, n BIGINT").json(f"{root}/json/all").select(F.lit("json").alias("kind"), "stage", "n")
    lines = t.spark.read.text(f"{root}/txt/all").select(
        F.lit("txt").alias("kind"), F.substring_index("value", ":", 1).alias("stage"),
        F.regexp_extract("value", " of ([0-9]+) ok", 1).cast("bigint").alias("n"))
    return stages.unionByName(lines).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("stage") != "total", F.col("n"))).alias("n_tasks"))
