"""Queries through files and streams: written to the shared folder first, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanfold.functions import scalars as S
from fanfold.operators import jobs as J
from fanfold.operators import telemetry as M
from fanfold.operators.logs import log_message
from fanfold.plans.catalog import PREFIX
from fanfold.plans.metrics import shown, start
from fanfold.plans.registry import Inputs, query
from fanfold.plans.tasks import STAGE
from fanfold.session import shared_dir
from fanfold.sources import files, records
from fanfold.sources.walk import walk_store
from fanfold.streaming import follow, landing, watch

PAGE_ROWS = 100
FILES_PER_BATCH = 1000  # only a matter of speed: results do not depend on it
ONE_FILE_EACH = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}


def fresh(t: Inputs) -> str:
    """A folder nobody has used yet."""
    return f"{shared_dir(t.spark)}/stored-{uuid.uuid4().hex}"


def write_lines(df: DataFrame, path: str) -> str:
    df.write.json(path)
    return path


# --- files -------------------------------------------------------------------------------------


@query("s1_listing", """
SELECT task_index::integer AS task_index, count(*) AS n_files FROM (
  SELECT DISTINCT task_index, status FROM fx_results) GROUP BY task_index
""", "fx_results")
def s1_listing(t: Inputs) -> DataFrame:
    """Results are stored per task index and status, then found again from the listing alone."""
    root = fresh(t)
    t.fx("fx_results").repartition("task_index", "status").write.partitionBy("task_index", "status").parquet(root)
    found = files.list_artifacts(t.spark, root).where(F.col("path").endswith(".parquet") & (F.col("length") > 0))
    index = F.regexp_extract("path", "/task_index=([0-9]+)/", 1).cast("int")
    return found.groupBy(index.alias("task_index")).agg(F.count(F.lit(1)).alias("n_files"))


@query("s1_walk", """
SELECT task_index::integer AS task_index, status, count(DISTINCT (task_index, status)) AS n_files FROM fx_results GROUP BY ALL
""", "fx_results")
def s1_walk(t: Inputs) -> DataFrame:
    """The same store, listed folder by folder in tasks."""
    root = fresh(t)
    t.fx("fx_results").repartition("task_index", "status").write.partitionBy("task_index", "status").parquet(root)
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
    found = walk_store(t.spark, root).where(F.col("path").endswith(".parquet") & (F.col("length") > 0))
    return found.groupBy(part("task_index").cast("int").alias("task_index"), part("status").alias("status")).agg(
        F.count(F.lit(1)).alias("n_files"))


@query("s1_manifest", f"""
SELECT path, length FROM fx_artifacts WHERE starts_with(path, '{PREFIX}1995') OR starts_with(path, '{PREFIX}199702/')
""", "fx_artifacts")
def s1_manifest(t: Inputs) -> DataFrame:
    """A stored inventory, cut by prefixes that reach the Parquet scan."""
    root = fresh(t)
    t.fx("fx_artifacts").select("path", "length", F.lit(None).cast("timestamp").alias("modificationTime")).write.parquet(root)
    return files.read_manifest(t.spark, root, [f"{PREFIX}1995", f"{PREFIX}199702/"]).select("path", "length")


@query("s4_roundtrip", "SELECT run_key, task_index, status, duration, unnest(['csv.gz', 'json.gz', 'parquet']) AS format FROM fx_results",
       "fx_results")
def s4_roundtrip(t: Inputs) -> DataFrame:
    root, results = fresh(t), t.fx("fx_results")
    schema, back = "run_key BIGINT, task_index INT, status STRING, duration DOUBLE", None
    for fmt in ("csv.gz", "json.gz", "parquet"):
        files.write_table(results, f"{root}/{fmt}", fmt)
        one = files.read_table(t.spark, f"{root}/{fmt}", fmt, schema).withColumn("format", F.lit(fmt))
        back = one if back is None else back.unionByName(one)
    return back


@query("s6_documents", """
SELECT c_mktsegment AS segment, count(*) AS n_documents, sum(c_custkey) AS keys, count(*) FILTER (c_acctbal < 0) AS n_negative
FROM customer GROUP BY 1
""")
def s6_documents(t: Inputs) -> DataFrame:
    """One folder per segment with JSON documents over several lines, objects and arrays of objects, read back as rows."""
    root, row = fresh(t), F.struct("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    one = t.customer.where("c_custkey % 100 = 0").select("c_mktsegment", "c_custkey", F.array(row).alias("rows"))
    many = t.customer.where("c_custkey % 100 <> 0").groupBy("c_mktsegment", F.floor(F.col("c_custkey") / 100).alias("c_custkey")).agg(
        F.collect_list(row).alias("rows"))
    # A file takes long for its size, so documents are dealt to a given number of tasks, however few bytes they are.
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = one.unionByName(many).repartition(tasks, "c_mktsegment", "c_custkey")
    texts = dealt.select("c_mktsegment", F.to_json("rows", {"pretty": "true"}).alias("value"))
    # A file holds one document. Tasks put their files in place themselves, so that the driver doesn't move them one by one.
    texts.write.partitionBy("c_mktsegment").options(**ONE_FILE_EACH).text(root)
    read = files.read_json_documents(t.spark, root, "c_custkey BIGINT, c_acctbal DOUBLE, c_mktsegment STRING")
    return read.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("c_custkey").alias("keys"), F.count_if(F.col("c_acctbal") < 0).alias("n_negative"))


@query("s8_outputs", """
SELECT 'results' AS "table", 'parquet' AS format, true AS saved, count(*) AS n FROM fx_results
UNION ALL SELECT 'runs', 'csv.gz', true, count(*) FROM fx_runs UNION ALL SELECT 'figure', '', false, 0
""", "fx_results", "fx_runs")
def s8_outputs(t: Inputs) -> DataFrame:
    root = fresh(t)
    tables = {"results": (t.fx("fx_results"), "parquet"), "runs": t.fx("fx_runs"), "figure": object()}
    report = files.write_outputs(t.spark, tables, root, "20240101-000000", "m1")
    target, counts = files.output_dir(root, "20240101-000000", "m1"), None
    for name, fmt in (("results", "parquet"), ("runs", "csv.gz")):
        one = files.read_table(t.spark, f"{target}/{name}.{fmt}", fmt).groupBy(F.lit(name).alias("table")).agg(
            F.count(F.lit(1)).alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    return report.join(counts, "table", "left").na.fill("", ["format"]).na.fill(0, ["n"])


# --- exported records --------------------------------------------------------------------------


@query("s12_pages", """
SELECT name, state, coalesce(start_time, '') AS start_time, coalesce(end_time, '') AS end_time, argument FROM fx_executions
""", "fx_executions")
def s12_pages(t: Inputs) -> DataFrame:
    """Listing pages of at most a hundred executions each, as the service hands them out."""
    row = F.struct("name", "state", F.col("start_time").alias("startTime"), F.col("end_time").alias("endTime"), "argument")
    number = F.floor(F.conv(F.substring(S.short_id(F.col("name")), 1, 8), 16, 10).cast("bigint") / PAGE_ROWS)
    pages = t.fx("fx_executions").groupBy(number.alias("page")).agg(F.collect_list(row).alias("executions"))
    path = write_lines(pages.select("executions", F.lit("next").alias("nextPageToken")), fresh(t))
    read = records.read_executions(t.spark, path, lines=True)
    return read.select("name", "state", "start_time", F.coalesce("end_time", F.lit("")).alias("end_time"), "argument")


@query("s13_jobs", """
SELECT job_id, 'flu/' || substr(job_id, 9) AS exp_id, (succeeded + failed) || '/' || (succeeded + failed + running) AS tasks_active, 'v7' AS tag
FROM fx_jobs
""", "fx_jobs")
def s13_jobs(t: Inputs) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    counts = F.create_map(F.lit("SUCCEEDED"), text("succeeded"), F.lit("FAILED"), text("failed"), F.lit("RUNNING"), text("running"))
    env = F.create_map(F.lit("EXP_ID"), F.concat(F.lit("flu/"), F.substring("job_id", 9, 8)))
    runnable = F.struct(F.struct(F.lit("host/proj/img:v7").alias("imageUri")).alias("container"))
    spec = F.struct(F.struct(env.alias("variables")).alias("environment"), F.array(runnable).alias("runnables"))
    exported = t.fx("fx_jobs").select(
        F.concat(F.lit("projects/p/jobs/"), "job_id").alias("name"),
        F.struct(F.lit("RUNNING").alias("state"), F.create_map(F.lit("group0"), F.struct(counts.alias("counts"))).alias("taskGroups")).alias("status"),
        F.array(F.struct(spec.alias("taskSpec"))).alias("taskGroups"))
    jobs = records.read_jobs(t.spark, write_lines(exported, fresh(t)), lines=True)
    return J.job_progress(J.unpack_counts(jobs)).select(
        "job_id", S.job_exp_id(F.col("env"), F.col("labels")).alias("exp_id"), "tasks_active",
        S.image_tag(F.col("image_uri")).alias("tag"))


@query("s14_logs", """
SELECT insert_id::string AS insert_id, severity, CASE WHEN text_payload <> '' THEN text_payload
  ELSE coalesce(json_payload->>'$.message', replace(json_payload, ' ', ''), '') END AS message FROM fx_logs
""", "fx_logs")
def s14_logs(t: Inputs) -> DataFrame:
    payload = F.from_json("json_payload", "message STRING, k BIGINT")
    exported = t.fx("fx_logs").select(
        F.col("insert_id").cast("string").alias("insertId"), F.col("timestamp").cast("timestamp").alias("timestamp"), "severity",
        F.col("text_payload").alias("textPayload"), payload.alias("jsonPayload"))
    logs = records.read_logs(t.spark, write_lines(exported, fresh(t)), lines=True)
    return logs.select("insert_id", "severity", log_message(F.col("text_payload"), F.col("json_payload")).alias("message"))


@query("s15_builds", """
SELECT string_split(name, '/')[-1] AS build_id, state AS status FROM fx_executions WHERE end_time IS NULL
ORDER BY start_time DESC, build_id LIMIT 15
""", "fx_executions")
def s15_builds(t: Inputs) -> DataFrame:
    exported = t.fx("fx_executions").select(S.short_id(F.col("name")).alias("id"), F.col("state").alias("status"),
                                            F.col("start_time").alias("startTime"), F.col("end_time").alias("finishTime"))
    builds = records.read_builds(t.spark, write_lines(exported, fresh(t)), lines=True)
    return J.build_history(builds, "2000-01-01T00:00:00Z", ongoing=True, limit=15).select("build_id", "status")


@query("m1_telemetry", f"""
SELECT coalesce(stage, 'total') AS stage, count(*) AS n, round(max(duration), 2) AS max_duration FROM (
  SELECT {STAGE} AS stage, sum(duration) AS duration FROM fx_results GROUP BY task_index) GROUP BY ROLLUP (stage)
""", "fx_results")
def m1_telemetry(t: Inputs) -> DataFrame:
    """One summary file per task: named by stage and index, and found by that name."""
    root = fresh(t)
    per_task = t.fx("fx_results").groupBy("task_index").agg(F.sum("duration").alias("duration"))
    stage = F.expr(STAGE)
    name = F.when(stage == "runner", F.format_string("runner_%05d_summary.json", "task_index")).otherwise(
        F.concat(stage, F.lit("_summary.json")))
    named = per_task.select(name.alias("file"), F.to_json(F.struct(F.lit("ok").alias("status"), "duration")).alias("value"))
    named.repartition("file").write.partitionBy("file").text(root)
    raw = M.read_telemetry(t.spark, root, by_folder=True)
    return M.workflow_summary(raw).select("stage", "n", F.round("max_duration", 2).alias("max_duration"))


# --- streams -----------------------------------------------------------------------------------


def stream(t: Inputs, select: list[str]) -> DataFrame:
    """The events table as a stream, with an instant as time; the table is a file or a folder of files."""
    raw = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(
        f"{t.folder}/events.parque[t]")  # a pattern may name a file or a folder
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(*select)


JOB_EVENTS = ["'job-' || cast(user_id AS string) AS job_id", "ts",
              "CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'SCHEDULED' WHEN 'error' THEN 'FAILED' "
              "WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'RUNNING' END AS state"]


@query("w1_follow", "SELECT insert_id, severity FROM fx_logs WHERE severity = 'ERROR' AND stage = 'runner'", "fx_logs")
def w1_follow(t: Inputs) -> DataFrame:
    """All matching entries arrive, those with equal timestamps included."""
    logs = stream(t, ["event_id AS insert_id", "ts AS timestamp",
                      "CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS severity",
                      "map('stage', CASE user_id % 3 WHEN 0 THEN 'builder' WHEN 1 THEN 'runner' ELSE 'output' END) AS labels"])
    root = fresh(t)
    follow.follow_logs(logs, f"{root}/out", f"{root}/state", once=True, stage="runner", severity="ERROR").awaitTermination()
    return follow.followed_logs(t.spark, f"{root}/out").select("insert_id", "severity")


@query("w2_watch", """
SELECT job_id, max_by(state, ts) AS state FROM fx_job_events GROUP BY job_id
""", "fx_job_events")
def w2_watch(t: Inputs) -> DataFrame:
    root = fresh(t)
    watch.watch_status(stream(t, JOB_EVENTS), f"{root}/out", f"{root}/state", once=True).awaitTermination()
    return watch.read_status(t.spark, f"{root}/out").select("job_id", "state")


@query("w3_stream", """
SELECT job_id, coalesce(prev, 'none') AS from_state, state AS to_state, substr(cast(ts AS string), 1, 19) AS ts FROM (
  SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY ts, state) AS prev FROM fx_job_events)
WHERE prev IS DISTINCT FROM state
""", "fx_job_events")
def w3_stream(t: Inputs) -> DataFrame:
    root = fresh(t)
    watch.watch_steps(stream(t, JOB_EVENTS), f"{root}/out", f"{root}/state", once=True).awaitTermination()
    steps = watch.read_steps(t.spark, f"{root}/out")
    return steps.select("job_id", F.coalesce("from_state", F.lit("none")).alias("from_state"), "to_state",
                        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("w4_arrivals", """
SELECT user_id AS run_key, 7 AS n_expected, count(DISTINCT event_id % 8) FILTER (event_id % 8 < 7) AS n_arrived,
  CASE WHEN count(DISTINCT event_id % 8) FILTER (event_id % 8 < 7) = 7 THEN 'complete' ELSE 'timed out' END AS state
FROM events GROUP BY user_id
""")
def w4_arrivals(t: Inputs) -> DataFrame:
    root = fresh(t)
    arrived = stream(t, ["user_id AS run_key", "event_id % 8 AS task_index", "'ok' AS status"])
    watch.watch_arrivals(arrived, f"{root}/out", f"{root}/state", once=True).awaitTermination()
    runs = t.events.groupBy(F.col("user_id").alias("run_key")).agg(F.max(F.col("ts").cast("timestamp")).alias("deadline"))
    results = landing.landed(t.spark, f"{root}/out").select("run_key", "task_index", "status")
    return watch.arrival_status(results, runs.withColumn("n_expected", F.lit(7)), "2030-01-01T00:00:00Z")


@query("w5_windows", f"""
SELECT {start(3600)}, metric, instance_name, round(avg(value), 6) AS value FROM fx_metrics GROUP BY ALL
""", "fx_metrics")
def w5_windows(t: Inputs) -> DataFrame:
    """Each batch lands its share of the buckets it touched; shares add up."""
    metrics = stream(t, ["'run-' || cast(user_id % 10 AS string) || '-stage-' || CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b-0' "
                         "ELSE 'c-0' END AS instance_name", "event_type AS metric", "ts", "value"])
    root = fresh(t)
    follow.follow_metrics(metrics, f"{root}/out", f"{root}/state", 3600, once=True).awaitTermination()
    return shown(follow.followed_metrics(t.spark, f"{root}/out"))
