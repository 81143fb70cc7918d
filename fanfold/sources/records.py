"""Exported executions, jobs, builds and logs, with fixed schemas; absent fields are NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXECUTION = ("STRUCT<name STRING, state STRING, startTime STRING, endTime STRING, argument STRING, "
             "labels MAP<STRING, STRING>, result STRING, error STRUCT<message STRING, code STRING>, "
             "status STRUCT<currentSteps ARRAY<STRUCT<step STRING>>>>")
JOB = ("name STRING, labels MAP<STRING, STRING>, createTime STRING, updateTime STRING, "
       "status STRUCT<state STRING, statusEvents ARRAY<STRUCT<eventTime STRING, description STRING>>, "
       "taskGroups MAP<STRING, STRUCT<counts MAP<STRING, STRING>>>>, "
       "taskGroups ARRAY<STRUCT<taskSpec STRUCT<environment STRUCT<variables MAP<STRING, STRING>>, "
       "runnables ARRAY<STRUCT<container STRUCT<imageUri STRING>>>>>>")
BUILD = "id STRING, status STRING, startTime STRING, finishTime STRING, images ARRAY<STRING>"
LOG = ("insertId STRING, timestamp TIMESTAMP, severity STRING, textPayload STRING, jsonPayload STRING, "
       "labels MAP<STRING, STRING>, resource STRUCT<type STRING, labels MAP<STRING, STRING>>")


def _json(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """One document or array per file, or with ``lines`` one document per line, which Spark can
    also split inside a large file."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_executions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Exported listing pages: ``{"executions": […], "nextPageToken": …}``."""
    pages = _json(spark, path, f"executions ARRAY<{EXECUTION}>, nextPageToken STRING", lines)
    rows = pages.select(F.explode("executions").alias("e")).select("e.*")
    steps = F.struct(F.col("status.currentSteps").alias("current_steps"))
    return rows.select("name", "state", F.col("startTime").alias("start_time"), F.col("endTime").alias("end_time"),
                       "argument", "labels", "result", "error", steps.alias("status"))


def read_jobs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Exported batch jobs; environment and image come from the first task group."""
    raw = _json(spark, path, JOB, lines)
    spec = F.get("taskGroups", F.lit(0)).getField("taskSpec")
    events = F.transform("status.statusEvents", lambda e: F.struct(e["eventTime"].alias("event_time")))
    return raw.select(
        "name", F.substring_index("name", "/", -1).alias("job_id"), "labels",
        F.col("createTime").alias("create_time"), F.col("updateTime").alias("update_time"),
        F.col("status.state").alias("state"), events.alias("events"),
        F.col("status.taskGroups").alias("task_groups"), spec["environment"]["variables"].alias("env"),
        F.get(spec["runnables"], F.lit(0))["container"]["imageUri"].alias("image_uri"))


def read_builds(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    raw = _json(spark, path, BUILD, lines)
    return raw.select(F.col("id").alias("build_id"), "status", F.col("startTime").alias("start_time"),
                      F.col("finishTime").alias("finish_time"), "images")


def read_logs(spark: SparkSession, path: str, streaming: bool = False, lines: bool = False,
              files_per_trigger: int = 100) -> DataFrame:
    """Exported log entries; a stream reads one entry per line."""
    if streaming:
        raw = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).json(path)
    else:
        raw = _json(spark, path, LOG, lines)
    return raw.select(
        F.col("insertId").alias("insert_id"), "timestamp", "severity", F.col("textPayload").alias("text_payload"),
        F.col("jsonPayload").alias("json_payload"), "labels", F.col("resource.type").alias("resource_type"),
        F.col("resource.labels").alias("resource_labels"))
