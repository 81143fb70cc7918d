"""Log filters and projections; the same functions serve batch and streaming frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanfold.functions import rules as Q
from fanfold.functions import scalars as S

FRESHNESS_DAYS = 30
BATCH_RESOURCE = "batch.googleapis.com/Job"
ORCHESTRATOR_RESOURCE = "workflows.googleapis.com/Workflow"
_CONSOLE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:]{8}) (\S+) ([A-Z]+) (?:\[Task ([0-9]+)\] )?(?s:(.*))\z"


def label(key: str) -> Column:
    return F.try_element_at(F.col("labels"), F.lit(key))


def same_stage(stage: str) -> Column:
    """Both sides are brought to the letters A, B, C."""
    return S.stage_letter(label("stage")) == S.stage_letter(F.lit(stage))


def of_execution(execution_id: str) -> Column:
    """Jobs of any stage whose id carries the first eight characters of the execution."""
    uid = label("job_uid")
    return uid.rlike(r"(?s)^stage-.-") & (F.substring(uid, 9, 8) == execution_id[:8])


def log_terms(resource: str | None = None, exp_id: str | None = None, run_id: str | None = None,
              stage: str | None = None, task_index: int | None = None, job: str | None = None,
              execution: str | None = None, severity: str | None = None,
              since: str | None = None) -> list[Column]:
    """One condition per given term; label values are sanitised as they were when written."""
    clean = lambda text: Q.sanitize_label(F.lit(text))
    build = {
        "resource": lambda v: F.col("resource_type") == v,
        "exp_id": lambda v: label("exp_id") == clean(v),
        "run_id": lambda v: label("run_id") == clean(v),
        "stage": same_stage,
        "task_index": lambda v: label("batch.task_index") == str(v),
        "job": lambda v: label("job_uid").startswith(v),
        "execution": of_execution,
        "severity": lambda v: F.col("severity") == v,
        "since": lambda v: F.col("timestamp") >= F.lit(v).cast("timestamp"),
    }
    given = {"resource": resource, "exp_id": exp_id, "run_id": run_id, "stage": stage,
             "task_index": task_index, "job": job, "execution": execution, "severity": severity,
             "since": since}
    return [build[name](value) for name, value in given.items() if value not in (None, "")]


def filter_logs(df: DataFrame, **terms) -> DataFrame:
    """Rows that meet every given term (see :func:`log_terms`)."""
    conditions = log_terms(**terms)
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def fresh(df: DataFrame, now: str, days: int = FRESHNESS_DAYS, date_column: str | None = None) -> DataFrame:
    """At most ``days`` old. The bound is a constant, so it reaches the scan; for a table that is
    partitioned by day name its ``date_column``, and older partitions are not opened."""
    floor = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    recent = df.where(F.col("timestamp") >= floor)
    return recent.where(F.col(date_column) >= floor.cast("date")) if date_column else recent


def tail(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows (0 = all), oldest first."""
    newest = df.orderBy(F.desc("timestamp"), F.desc("insert_id")).limit(n) if n else df
    return newest.orderBy("timestamp", "insert_id")


def one_line(text: Column) -> Column:
    return F.translate(text, "\n\r", "  ")


def log_message(text: Column, payload: Column) -> Column:
    """The text, else the ``message`` of the JSON payload, else the payload itself, else empty."""
    return one_line(F.coalesce(F.nullif(text, F.lit("")), F.get_json_object(payload, "$.message"),
                               F.nullif(payload, F.lit("")), F.lit("")))


def log_context(stage: Column, task_index: Column) -> Column:
    """`` [stage=…, task=…]`` of what is known, else empty."""
    parts = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{name}="), v))
             for name, v in (("stage", stage), ("task", task_index))]
    inside = F.concat_ws(", ", *parts)
    return F.when(inside == "", "").otherwise(F.concat(F.lit(" ["), inside, F.lit("]")))


STRUCTURED = ("asctime", "name", "severity", "message", "stage", "exp_id", "run_id", "task_index")


def parse_json_line(line: Column) -> Column:
    """The known fields of a structured line, and all others in the map ``extras``."""
    every = F.from_json(line, "MAP<STRING, STRING>")
    known = [F.try_element_at(every, F.lit(f)).alias(f) for f in STRUCTURED[:-1]]
    extras = F.map_filter(every, lambda k, _: ~k.isin(*STRUCTURED))
    return F.struct(*known, F.try_element_at(every, F.lit("task_index")).try_cast("int").alias("task_index"),
                    extras.alias("extras"))


def parse_console_line(line: Column) -> Column:
    """``<time> <stage> <LEVEL> [Task n] <message>``; NULL fields where the line differs."""
    part = lambda i: F.when(line.rlike(_CONSOLE), F.regexp_extract(line, _CONSOLE, i))
    return F.struct(part(1).alias("ts"), part(2).alias("stage"), part(3).alias("severity"),
                    part(4).try_cast("int").alias("task_index"), part(5).alias("message"))


def error_counts(df: DataFrame) -> DataFrame:
    """Error records by failed stage and type."""
    return df.where("severity = 'ERROR'").groupBy("failed_stage", "error_type").agg(
        F.count(F.lit(1)).alias("n"))


def orchestrator_logs(df: DataFrame, workflow: str, location: str, execution_id: str) -> DataFrame:
    resource = F.col("resource_labels")
    return df.where((F.col("resource_type") == ORCHESTRATOR_RESOURCE)
                    & (F.try_element_at(resource, F.lit("workflow_id")) == workflow)
                    & (F.try_element_at(resource, F.lit("location")) == location)
                    & (label("execution_id") == execution_id))
