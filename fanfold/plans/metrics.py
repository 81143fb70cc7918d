"""Metric, dashboard and alert queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanfold.operators import metrics as V
from fanfold.plans.registry import Inputs, query

HOUR = 3600
TILE_METRICS = {"cpu": "view", "cores": "click", "used": "purchase", "size": "signup"}


def metrics(t: Inputs) -> DataFrame:
    return t.fx("fx_metrics")


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = {"window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")}
    return df.withColumns(cols | ({"value": F.round("value", digits)} if "value" in df.columns else {}))


def start(seconds: int) -> str:
    return f"substr(cast(time_bucket(INTERVAL {seconds} SECOND, ts) AS string), 1, 19) AS window_start"


@query("v1_mean", f"""
SELECT {start(60)}, metric, instance_name, round(avg(value), 6) AS value FROM fx_metrics GROUP BY ALL
""", "fx_metrics")
def v1_mean(t: Inputs) -> DataFrame:
    return shown(V.align_mean(metrics(t)))


@query("v1_hourly", f"""
SELECT {start(HOUR)}, metric, instance_name, round(avg(value), 6) AS value FROM fx_metrics GROUP BY ALL
""", "fx_metrics")
def v1_hourly(t: Inputs) -> DataFrame:
    return shown(V.align_mean(metrics(t), HOUR))


@query("v2_rate", f"""
SELECT {start(HOUR)}, metric, instance_name, round(sum(value) / {HOUR}, 8) AS value FROM fx_metrics GROUP BY ALL
""", "fx_metrics")
def v2_rate(t: Inputs) -> DataFrame:
    return shown(V.align_rate(metrics(t), HOUR), 8)


@query("v2_counter", f"""
SELECT {start(HOUR)}, metric, instance_name, round(sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value
  ELSE value - prev END) / {HOUR}, 8) AS value
FROM (SELECT *, lag(value) OVER (PARTITION BY metric, instance_name ORDER BY ts, value) AS prev FROM fx_metrics) GROUP BY ALL
""", "fx_metrics")
def v2_counter(t: Inputs) -> DataFrame:
    return shown(V.align_rate(metrics(t), HOUR, "cumulative"), 8)


@query("v3_ratio", f"""
SELECT window_start, instance_name, round(avg(value) FILTER (metric = 'purchase') / avg(value) FILTER (metric = 'signup'), 6) AS value
FROM (SELECT {start(HOUR)}, instance_name, metric, value FROM fx_metrics) GROUP BY ALL
HAVING count(*) FILTER (metric = 'purchase') > 0 AND count(*) FILTER (metric = 'signup') > 0
""", "fx_metrics")
def v3_ratio(t: Inputs) -> DataFrame:
    return shown(V.ratio(metrics(t), "purchase", "signup", HOUR))


@query("v4_active", f"""
SELECT {start(HOUR)}, count(DISTINCT metric || '/' || instance_name) AS active FROM fx_metrics GROUP BY ALL
""", "fx_metrics")
def v4_active(t: Inputs) -> DataFrame:
    return shown(V.active_count(metrics(t), HOUR))


@query("v5_stage", """
SELECT instance_name, count(*) AS n FROM fx_metrics
WHERE regexp_full_match(instance_name, 'run-.*-stage-a') OR regexp_full_match(instance_name, 'run-[0-4]-stage-b.*') GROUP BY ALL
""", "fx_metrics")
def v5_stage(t: Inputs) -> DataFrame:
    staged = V.by_stage(metrics(t), "run-.*-stage-a", "run-[0-4]-stage-b.*")
    return staged.groupBy("instance_name").agg(F.count(F.lit(1)).alias("n"))


def tile_sql() -> str:
    """Each tile as its own select over hourly means and sums."""
    parts = []
    for tile in V.standard_tiles(TILE_METRICS):
        mine = f"FROM aligned WHERE regexp_full_match(instance_name, '{tile.pattern}')"
        head = f"SELECT '{tile.dashboard}' AS dashboard, '{tile.title}' AS tile, window_start,"
        if tile.kind == "count":
            parts.append(f"{head} 'all' AS series, count(*)::double AS value {mine} AND metric = '{tile.metric}' GROUP BY window_start")
        elif tile.kind == "ratio":
            parts.append(f"{head} instance_name AS series, round(max(mean) FILTER (metric = '{tile.metric}') / "
                         f"max(mean) FILTER (metric = '{tile.base}'), 6) AS value {mine} GROUP BY window_start, instance_name "
                         f"HAVING count(DISTINCT metric) FILTER (metric IN ('{tile.metric}', '{tile.base}')) = 2")
        else:
            value = "mean" if tile.kind == "mean" else f"total / {HOUR}"
            parts.append(f"{head} instance_name AS series, round({value}, 6) AS value {mine} AND metric = '{tile.metric}'")
    return (f"WITH aligned AS (SELECT {start(HOUR)}, metric, instance_name, avg(value) AS mean, sum(value) AS total "
            f"FROM fx_metrics GROUP BY ALL) " + " UNION ALL ".join(parts))


@query("v6_dashboard", tile_sql(), "fx_metrics")
def v6_dashboard(t: Inputs) -> DataFrame:
    return shown(V.dashboard(metrics(t), V.standard_tiles(TILE_METRICS), HOUR))


@query("v7_alerts", """
SELECT job_id, failed, succeeded + failed + running AS total, round(failed / (succeeded + failed + running), 6) AS failure_rate
FROM fx_jobs WHERE failed > 0.1 * (succeeded + failed + running)
""", "fx_jobs")
def v7_alerts(t: Inputs) -> DataFrame:
    return V.failure_alerts(t.fx("fx_jobs")).withColumn("failure_rate", F.round("failure_rate", 6))


@query("v8_budget", """
WITH daily AS (SELECT day, sum(hours) AS cost FROM fx_usage GROUP BY day),
spent AS (SELECT day, substr(cast(day AS string), 1, 7) AS month,
  sum(cost) OVER (PARTITION BY substr(cast(day AS string), 1, 7) ORDER BY day) AS spent FROM daily)
SELECT month, level, min(cast(day AS string)) AS day FROM spent, (VALUES (0.5::double), (0.8), (1.0)) l(level)
WHERE spent >= level * 15000 GROUP BY ALL
""", "fx_usage")
def v8_budget(t: Inputs) -> DataFrame:
    spending = t.fx("fx_usage").select("day", F.col("hours").alias("cost"))
    return V.budget_crossings(spending, 15000.0).withColumn("day", F.col("day").cast("string"))
