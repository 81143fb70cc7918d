"""Execution, job and build queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanfold.functions import scalars as S
from fanfold.operators import jobs as J
from fanfold.plans.registry import Inputs, query

NOW = "2000-01-01T00:00:00Z"
STATE_SQL = "CASE WHEN running > 0 THEN 'RUNNING' WHEN failed > 0 THEN 'FAILED' ELSE 'SUCCEEDED' END"


def executions(t: Inputs) -> DataFrame:
    return t.fx("fx_executions")


def jobs(t: Inputs) -> DataFrame:
    return t.fx("fx_jobs")


@query("j1_state", "SELECT name, state FROM fx_executions WHERE state IN ('SUCCEEDED', 'FAILED', 'CANCELLED')",
       "fx_executions")
def j1_state(t: Inputs) -> DataFrame:
    return J.with_state(executions(t), J.RECENT_EXECUTION).select("name", "state")


@query("j2_newest", """
SELECT name, state, start_time FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY start_time DESC, name DESC) AS nth
  FROM fx_executions) WHERE nth <= 20
""", "fx_executions")
def j2_newest(t: Inputs) -> DataFrame:
    return J.newest_per_state(executions(t)).select("name", "state", "start_time")


@query("j3_since", """
SELECT name, 'ended' AS kind FROM fx_executions WHERE end_time >= '1998-01-01T03:30:30Z'
UNION ALL SELECT name, 'started' FROM fx_executions WHERE start_time > '1998-01-01T00:00:00Z'
""", "fx_executions")
def j3_since(t: Inputs) -> DataFrame:
    ended = J.ended_since(executions(t), "1998-01-01T03:30:30Z").select("name", F.lit("ended").alias("kind"))
    started = J.started_after(executions(t), "1998-01-01T00:00:00Z").select("name", F.lit("started").alias("kind"))
    return ended.unionByName(started)


@query("j4_experiment", "SELECT name, argument FROM fx_executions WHERE contains(argument, 'flu/7')", "fx_executions")
def j4_experiment(t: Inputs) -> DataFrame:
    return J.mentions_experiment(executions(t), "flu/7").select("name", "argument")


@query("j4_label", "SELECT job_id FROM fx_jobs WHERE ('0x' || substr(job_id, 9))::bigint % 9 = 4", "fx_jobs")
def j4_label(t: Inputs) -> DataFrame:
    exp = F.concat(F.lit("flu-exp-"), F.conv(F.substring("job_id", 9, 8), 16, 10).cast("bigint") % 9)
    labelled = jobs(t).withColumn("labels", F.create_map(F.lit("exp_id"), exp))
    return J.jobs_of_experiment(labelled, "Flu/Exp 4").select("job_id")


@query("j5_exp_id", """
SELECT name, CASE WHEN json_valid(argument) THEN coalesce(argument->>'$.exp_id', 'unknown') ELSE 'unknown' END AS exp_id
FROM fx_executions
""", "fx_executions")
def j5_exp_id(t: Inputs) -> DataFrame:
    return J.with_experiment(executions(t)).select("name", "exp_id")


def order_sql(order: str, columns: str, source: str) -> str:
    return f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS rank FROM {source}"


# The three orders of lists, each whole and with its places.
@query("j6_sorted", order_sql("end_time DESC, name", "name, end_time", "fx_executions WHERE state IN ('SUCCEEDED', 'FAILED', 'CANCELLED')"),
       "fx_executions")
def j6_sorted(t: Inputs) -> DataFrame:
    return J.ranked(J.with_state(executions(t), J.RECENT_EXECUTION), J.recent_order).select("name", "end_time", "rank")


@query("j6_active", order_sql("exp_id, name", "name, exp_id", """(SELECT name, CASE WHEN json_valid(argument)
  THEN coalesce(argument->>'$.exp_id', 'unknown') ELSE 'unknown' END AS exp_id FROM fx_executions WHERE state = 'ACTIVE')"""), "fx_executions")
def j6_active(t: Inputs) -> DataFrame:
    active = J.with_experiment(J.with_state(executions(t), J.ACTIVE_EXECUTION))
    return J.ranked(active, J.active_order).select("name", "exp_id", "rank")


CREATED = """SELECT 'stage-b-' || cast(l_orderkey AS string) AS job_id, cast(max(cast(l_shipdate AS date)) AS string) || 'T00:00:00Z' AS create_time
FROM {lineitem} GROUP BY l_orderkey"""


@query("j6_jobs", order_sql("create_time DESC, job_id", "job_id, create_time", f"({CREATED.format(lineitem='lineitem')})"))
def j6_jobs(t: Inputs) -> DataFrame:
    return J.ranked(t.sql(CREATED), J.newest_jobs).select("job_id", "create_time", "rank")


@query("j7_enrich", """
SELECT name, state, CASE WHEN right(name, 6) = '0-0000' THEN 'none' ELSE argument END AS argument FROM fx_executions
""", "fx_executions")
def j7_enrich(t: Inputs) -> DataFrame:
    listed = executions(t).withColumn("argument", F.lit("none"))
    details = executions(t).where("right(name, 6) <> '0-0000'")
    return J.enrich(listed, details).select("name", "state", "argument")


@query("j8_limit", """
SELECT name, start_time FROM fx_executions WHERE state = 'ACTIVE' AND contains(argument, 'flu/1')
  AND start_time > '1996-01-01T00:00:00Z' ORDER BY start_time DESC, name DESC LIMIT 30
""", "fx_executions")
def j8_limit(t: Inputs) -> DataFrame:
    found = J.executions(executions(t), details=executions(t), states=J.ACTIVE_EXECUTION, exp="flu/1",
                         since="1996-01-01T00:00:00Z", limit=30)
    return found.select("name", "start_time")


SECONDS = "cast(epoch(coalesce(end_time, '2000-01-01T00:00:00Z')::timestamp) - epoch(start_time::timestamp) AS bigint)"
TEXT = """CASE WHEN s < 0 THEN '0s' WHEN s < 60 THEN s || 's'
  WHEN s < 3600 THEN (s // 60) || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || (s % 60) || 's' ELSE '' END
  WHEN s < 86400 THEN (s // 3600) || 'h' || CASE WHEN s % 3600 // 60 > 0 THEN ' ' || (s % 3600 // 60) || 'm' ELSE '' END
  ELSE (s // 86400) || 'd' || CASE WHEN s % 86400 // 3600 > 0 THEN ' ' || (s % 86400 // 3600) || 'h' ELSE '' END END"""


# What one execution shows, in words of both engines: argument, result and error as the service hands them out.
DETAIL = {
    "argument": """CASE WHEN argument = 'not json' THEN argument ELSE replace(argument, '}', ', "profile": "p' || substr(start_time, 4, 1) ||
      CASE WHEN substr(start_time, 7, 1) = '1' THEN '' ELSE '", "billingProject": "b' || substr(start_time, 7, 1) END || '"}') END""",
    "result": """CASE state WHEN 'SUCCEEDED' THEN '{"month": ' || substr(start_time, 7, 1) || '}' END""",
    "error": "CASE state WHEN 'FAILED' THEN 'failed at ' || end_time END",
}


def argument_sql(field: str) -> str:
    return f"CASE WHEN json_valid(argument) THEN coalesce(argument->>'$.{field}', '') ELSE '' END"


@query("j9_detail", f"""
SELECT string_split(name, '/')[-1] AS execution_id, state, start_time, end_time, {TEXT} AS duration,
  {argument_sql("exp_id")} AS exp_id, {argument_sql("profile")} AS profile, {argument_sql("billingProject")} AS billing_project,
  argument, result, error
FROM (SELECT name, state, start_time, end_time, {SECONDS} AS s, {", ".join(f"{e} AS {c}" for c, e in DETAIL.items())} FROM fx_executions)
""", "fx_executions")
def j9_detail(t: Inputs) -> DataFrame:
    shown = executions(t).selectExpr("name", "state", "start_time", "end_time", *[f"{e} AS {c}" for c, e in DETAIL.items()])
    detail = J.execution_detail(shown, NOW)
    return detail.withColumn("exp_id", F.coalesce(F.get_json_object("argument", "$.exp_id"), F.lit("")))


@query("j9_steps", """
SELECT name, unnest(['step_0', 'step_1']) AS step FROM fx_executions WHERE state = 'ACTIVE'
""", "fx_executions")
def j9_steps(t: Inputs) -> DataFrame:
    step = lambda i: F.struct(F.lit(f"step_{i}").alias("step"))
    active = J.with_state(executions(t), J.ACTIVE_EXECUTION)
    return J.current_steps(active.withColumn("status", F.struct(F.array(step(0), step(1)).alias("current_steps"))))


def spread(t: Inputs) -> DataFrame:
    """Jobs as exported: environment, labels and counts as maps, some of them absent."""
    n = F.conv(F.substring("job_id", 9, 8), 16, 10).cast("bigint")
    text = lambda c: F.col(c).cast("string")
    counts = F.create_map(F.lit("SUCCEEDED"), text("succeeded"), F.lit("FAILED"), text("failed"),
                          F.lit("RUNNING"), text("running"))
    groups = F.create_map(F.lit("group0"), F.struct(counts.alias("counts")))
    exp = F.concat(F.lit("flu/"), (n % 50).cast("string"))
    return jobs(t).select(
        "job_id", n.alias("n"), F.expr(STATE_SQL).alias("state"),
        F.when(n % 3 > 0, F.create_map(F.lit("EXP_ID"), exp)).alias("env"),
        F.when(n % 2 == 0, F.create_map(F.lit("exp_id"), F.lit("label"))).alias("labels"),
        F.when(n % 7 > 0, groups).alias("task_groups"))


@query("j10_exp", """
SELECT job_id, CASE WHEN n % 3 > 0 THEN 'flu/' || n % 50 WHEN n % 2 = 0 THEN 'label' ELSE 'unknown' END AS exp_id
FROM (SELECT *, ('0x' || substr(job_id, 9))::bigint AS n FROM fx_jobs)
""", "fx_jobs")
def j10_exp(t: Inputs) -> DataFrame:
    return spread(t).select("job_id", S.job_exp_id(F.col("env"), F.col("labels")).alias("exp_id"))


@query("j11_progress", """
SELECT job_id, CASE WHEN n % 7 = 0 THEN 'N/A' WHEN succeeded + failed + running > 0
    THEN (succeeded + failed) || '/' || (succeeded + failed + running) ELSE 'pending' END AS tasks_active,
  CASE WHEN n % 7 = 0 OR succeeded + failed = 0 THEN 'N/A' ELSE succeeded || '/' || (succeeded + failed) END AS tasks_recent
FROM (SELECT *, ('0x' || substr(job_id, 9))::bigint AS n FROM fx_jobs)
""", "fx_jobs")
def j11_progress(t: Inputs) -> DataFrame:
    return J.job_progress(J.unpack_counts(spread(t))).select("job_id", "tasks_active", "tasks_recent")


@query("j12_end", """
SELECT name, CASE WHEN state = 'FAILED' THEN end_time WHEN state = 'SUCCEEDED' THEN end_time || '+' ELSE start_time END AS effective_end
FROM fx_executions
""", "fx_executions")
def j12_end(t: Inputs) -> DataFrame:
    event = lambda c: F.struct(F.col(c).alias("event_time"))
    events = F.when(F.col("state") == "FAILED", F.array(event("start_time"), event("end_time"))).otherwise(F.array())
    update = F.when(F.col("state") == "SUCCEEDED", F.concat("end_time", F.lit("+"))).otherwise("")
    return executions(t).select("name", S.effective_end(events, update, F.col("start_time")).alias("effective_end"))


@query("j13_duration", f"SELECT name, {SECONDS} AS seconds FROM fx_executions", "fx_executions")
def j13_duration(t: Inputs) -> DataFrame:
    return executions(t).select("name", S.duration_seconds(F.col("start_time"), F.col("end_time"), NOW).alias("seconds"))


@query("j14_tag", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'v' || p_size WHEN 1 THEN 'sha256:' || substr(md5(p_name), 1, 7)
  WHEN 2 THEN 'latest' ELSE 'unknown' END AS tag FROM part
""")
def j14_tag(t: Inputs) -> DataFrame:
    uri = F.concat(F.lit("host:5000/proj/repo/"), F.lower("p_brand"))
    kind = F.col("p_partkey") % 4
    image = (F.when(kind == 0, F.concat(uri, F.lit(":v"), "p_size"))
             .when(kind == 1, F.concat(uri, F.lit("@sha256:"), F.md5("p_name"))).when(kind == 2, uri).otherwise(""))
    return t.part.select("p_partkey", S.image_tag(image).alias("tag"))


@query("j15_totals", f"""
SELECT * FROM (SELECT count(*) FILTER (state = 'ACTIVE') AS active_workflows,
  count(*) FILTER (state IN ('SUCCEEDED', 'FAILED')) AS recent_workflows FROM fx_executions),
  (SELECT count(*) FILTER (state = 'RUNNING') AS active_jobs, count(*) FILTER (state <> 'RUNNING') AS recent_jobs
   FROM (SELECT {STATE_SQL} AS state FROM fx_jobs))
""", "fx_executions", "fx_jobs")
def j15_totals(t: Inputs) -> DataFrame:
    return J.status_totals(executions(t), jobs(t).withColumn("state", F.expr(STATE_SQL)))


@query("j16_link", """
SELECT name, state, stage_letter, 'stage-' || stage_letter || '-' || substr(string_split(name, '/')[-1], 1, 8) AS job_id,
  j.succeeded FROM (SELECT *, unnest(['a', 'b', 'c']) AS stage_letter FROM fx_executions)
  JOIN fx_jobs j ON j.job_id = 'stage-' || stage_letter || '-' || substr(string_split(name, '/')[-1], 1, 8)
UNION ALL SELECT name, state, stage_letter, 'stage-' || stage_letter || '-' || substr(string_split(name, '/')[-1], 1, 8), -1
  FROM (SELECT *, unnest(['a', 'b', 'c']) AS stage_letter FROM fx_executions)
  WHERE 'stage-' || stage_letter || '-' || substr(string_split(name, '/')[-1], 1, 8) NOT IN (SELECT job_id FROM fx_jobs)
""", "fx_executions", "fx_jobs")
def j16_link(t: Inputs) -> DataFrame:
    linked = J.jobs_of_execution(executions(t), jobs(t).select("job_id", "succeeded"))
    return linked.na.fill(-1, ["succeeded"])


@query("j17_run", f"""
SELECT job_id, {STATE_SQL} AS state FROM fx_jobs WHERE running > 0
  AND ('0x' || substr(job_id, 9))::bigint % 40 = 8 AND ('0x' || substr(job_id, 9))::bigint % 5 = 3
""", "fx_jobs")
def j17_run(t: Inputs) -> DataFrame:
    labels = F.create_map(F.lit("run_id"), F.concat(F.lit("run-"), F.col("n") % 40),
                          F.lit("exp_id"), F.concat(F.lit("flu-"), F.col("n") % 5))
    return J.jobs_of_run(spread(t).withColumn("labels", labels), "flu/3", "run-8").select("job_id", "state")


@query("j18_names", """
SELECT name, string_split(name, '/')[-1] AS short, name AS "full" FROM fx_executions
""", "fx_executions")
def j18_names(t: Inputs) -> DataFrame:
    short = S.short_id(F.col("name"))
    return executions(t).select("name", short.alias("short"),
                                S.full_name(short, "projects/p/locations/l/workflows/w").alias("full"))


@query("j19_builds", f"""
SELECT build_id, status, start_time, s AS seconds, {TEXT} AS duration FROM (
  SELECT string_split(name, '/')[-1] AS build_id, state AS status, start_time, {SECONDS} AS s FROM fx_executions
  WHERE end_time IS NULL) ORDER BY start_time DESC, build_id LIMIT 15
""", "fx_executions")
def j19_builds(t: Inputs) -> DataFrame:
    builds = executions(t).select(S.short_id(F.col("name")).alias("build_id"), F.col("state").alias("status"),
                                  "start_time", F.col("end_time").alias("finish_time"))
    return J.build_history(builds, NOW, ongoing=True, limit=15)


@query("j20_class", """
SELECT name, CASE state WHEN 'ACTIVE' THEN 'active' WHEN 'FAILED' THEN 'failure' ELSE 'success' END AS state_class FROM fx_executions
""", "fx_executions")
def j20_class(t: Inputs) -> DataFrame:
    return executions(t).select("name", S.state_class(F.col("state")).alias("state_class"))


@query("j20_counts", """
SELECT count(*) FILTER (state = 'SUCCEEDED') AS success, count(*) FILTER (state = 'FAILED') AS failure,
  count(*) FILTER (state = 'ACTIVE') AS active FROM fx_executions
""", "fx_executions")
def j20_counts(t: Inputs) -> DataFrame:
    classes = executions(t).withColumn("state_class", S.state_class(F.col("state")))
    return J.class_counts(classes).select("success", "failure", "active")
