"""Workflow executions, batch jobs and builds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fanfold.functions import rules as Q
from fanfold.functions import scalars as S
from fanfold.operators.ordering import number_rows

# States of executions and jobs.
ACTIVE_EXECUTION = ["ACTIVE"]
RECENT_EXECUTION = ["SUCCEEDED", "FAILED", "CANCELLED"]
ACTIVE_JOB = ["RUNNING", "QUEUED", "SCHEDULED"]
RECENT_JOB = ["SUCCEEDED", "FAILED"]
JOB_KEY_LENGTH = 8
PAGE = 20


def with_state(df: DataFrame, states: Sequence[str], column: str = "state") -> DataFrame:
    return df.where(F.col(column).isin(list(states)))


def newest_per_state(df: DataFrame, k: int = PAGE) -> DataFrame:
    """The ``k`` latest starts of each state; Spark cuts to ``k`` in every task before the shuffle."""
    latest = W.partitionBy("state").orderBy(F.desc(S.instant(F.col("start_time"))), F.desc("name"))
    return df.withColumn("__nth", F.row_number().over(latest)).where(F.col("__nth") <= k).drop("__nth")


def ended_since(df: DataFrame, moment: str) -> DataFrame:
    return df.where(S.instant(F.col("end_time")) >= F.lit(moment).cast("timestamp"))


def started_after(df: DataFrame, moment: str) -> DataFrame:
    """Strictly after; an unreadable start is not listed."""
    return df.where(S.instant(F.col("start_time")) > F.lit(moment).cast("timestamp"))


def mentions_experiment(df: DataFrame, exp_id: str) -> DataFrame:
    return df.where(F.col("argument").contains(exp_id))


def jobs_of_experiment(jobs: DataFrame, exp_id: str) -> DataFrame:
    """Labels are stored sanitised, so the asked value is sanitised too."""
    return jobs.where(F.try_element_at("labels", F.lit("exp_id")) == Q.sanitize_label(F.lit(exp_id)))


def execution_exp_id(argument: Column, labels: Column | None = None) -> Column:
    """From the JSON argument, else the label, else ``unknown``; broken JSON is no error."""
    given = F.nullif(F.get_json_object(argument, "$.exp_id"), F.lit("unknown"))
    label = [] if labels is None else [F.try_element_at(labels, F.lit("exp_id"))]
    return F.coalesce(given, *label, F.lit("unknown"))


def with_experiment(df: DataFrame) -> DataFrame:
    labels = F.col("labels") if "labels" in df.columns else None
    return df.withColumn("exp_id", execution_exp_id(F.col("argument"), labels))


def active_order(df: DataFrame) -> DataFrame:
    return df.orderBy("exp_id", "name")


def recent_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc(S.instant(F.col("end_time"))), "name")


def newest_jobs(df: DataFrame) -> DataFrame:
    """Jobs by create time, newest first."""
    return df.orderBy(F.desc(S.instant(F.col("create_time"))), "job_id")


def ranked(df: DataFrame, order: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows with their place (from 1) in one of the orders above, so that the order outlives further steps."""
    return number_rows(order(df), "rank")


def enrich(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Adds the argument by name; a listed row without details stays."""
    looked_up = details.select("name", F.col("argument").alias("__argument"))
    joined = listed.join(looked_up, "name", "left")
    return joined.withColumn("argument", F.coalesce("__argument", "argument")).drop("__argument")


def latest_started(df: DataFrame, limit: int) -> DataFrame:
    ordered = df.orderBy(F.desc(S.instant(F.col("start_time"))), F.desc("name"))
    return ordered.limit(limit) if limit else ordered


def executions(df: DataFrame, details: DataFrame | None = None, states: Sequence[str] | None = None,
               exp: str | None = None, since: str | None = None, limit: int = 0) -> DataFrame:
    """All filters first, then the argument look-up, then the limit."""
    rows = with_state(df, states) if states else df
    rows = started_after(rows, since) if since else rows
    rows = enrich(rows, details) if details is not None else rows
    rows = mentions_experiment(rows, exp) if exp else rows
    return latest_started(rows, limit)


def execution_detail(df: DataFrame, now: str) -> DataFrame:
    """Fields of one execution's view, parsed from the argument, error and status."""
    argument = F.col("argument")
    seconds = S.duration_seconds(F.col("start_time"), F.col("end_time"), now)
    return df.select(
        S.short_id(F.col("name")).alias("execution_id"), "state", "start_time", "end_time",
        S.duration_text(seconds).alias("duration"),
        *[F.coalesce(F.get_json_object(argument, f"$.{field}"), F.lit("")).alias(name)
          for field, name in [("profile", "profile"), ("billingProject", "billing_project")]],
        argument.alias("argument"),
        *[c for c in ("result", "error") if c in df.columns])


def current_steps(df: DataFrame) -> DataFrame:
    return df.select("name", F.explode("status.current_steps").alias("s")).select(
        "name", F.coalesce("s.step", F.lit("unknown")).alias("step"))


# --- jobs --------------------------------------------------------------------------------------


def first_group_counts(task_groups: Column) -> Column:
    """Counts of the first task group of ``MAP<STRING, STRUCT<counts>>``; NULL without groups."""
    return F.get(F.map_values(task_groups), F.lit(0)).getField("counts")


def unpack_counts(jobs: DataFrame) -> DataFrame:
    """Adds ``succeeded, failed, running, pending``; counts may be texts, an absent one is 0."""
    counts = first_group_counts(F.col("task_groups"))
    known = counts.isNotNull()
    number = lambda key: F.coalesce(F.try_element_at(counts, F.lit(key)).try_cast("bigint"), F.lit(0))
    return jobs.select("*", *[F.when(known, number(k.upper())).alias(k)
                              for k in ("succeeded", "failed", "running", "pending")])


def job_progress(jobs: DataFrame) -> DataFrame:
    """``tasks_active`` as done/total and ``tasks_recent`` as succeeded/finished."""
    succeeded, failed = F.col("succeeded"), F.col("failed")
    done = succeeded + failed
    total = done + F.col("running") + F.col("pending")
    active = (F.when(total.isNull(), "N/A").when(total > 0, F.concat_ws("/", done, total))
              .when(F.col("running") > 0, F.format_string("%d running", "running")).otherwise("pending"))
    recent = F.when(done > 0, F.concat_ws("/", succeeded, done)).otherwise("N/A")
    return jobs.select("*", active.alias("tasks_active"), recent.alias("tasks_recent"))


def status_totals(execs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Active and recent executions and jobs in one row."""
    tagged = execs.select(F.lit("workflow").alias("kind"), "state").unionByName(
        jobs.select(F.lit("job").alias("kind"), "state"))
    kinds = [("active_workflows", "workflow", ACTIVE_EXECUTION), ("active_jobs", "job", ACTIVE_JOB),
             ("recent_workflows", "workflow", RECENT_EXECUTION), ("recent_jobs", "job", RECENT_JOB)]
    return tagged.agg(*[F.count_if((F.col("kind") == kind) & F.col("state").isin(states)).alias(name)
                        for name, kind, states in kinds])


def job_key(name: Column) -> Column:
    return F.substring(S.short_id(name), 1, JOB_KEY_LENGTH)


def jobs_of_execution(execs: DataFrame, jobs: DataFrame) -> DataFrame:
    """The three stage jobs an execution would have; ``job_id`` is derived, so an equi-join finds them."""
    letters = F.explode(F.array(*map(F.lit, "abc"))).alias("stage_letter")
    wanted = execs.select("name", "state", letters).withColumn(
        "job_id", F.concat_ws("-", F.lit("stage"), "stage_letter", job_key(F.col("name"))))
    return wanted.join(jobs, "job_id", "left")


def jobs_of_run(jobs: DataFrame, exp_id: str, run_id: str, active_only: bool = True) -> DataFrame:
    label = lambda key: F.try_element_at("labels", F.lit(key))
    rows = jobs.where((label("run_id") == Q.sanitize_label(F.lit(run_id)))
                      & (label("exp_id") == Q.sanitize_label(F.lit(exp_id))))
    return with_state(rows, ACTIVE_JOB) if active_only else rows


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy().pivot("state_class", ["success", "failure", "active", "scheduled", "other"]).count()


def build_history(builds: DataFrame, now: str, ongoing: bool = False, limit: int = 0) -> DataFrame:
    """Builds newest first with their duration, or the time since the start while they run."""
    rows = builds.where("finish_time is null") if ongoing else builds
    seconds = S.duration_seconds(F.col("start_time"), F.col("finish_time"), now)
    shown = rows.select("build_id", "status", "start_time", seconds.alias("seconds"),
                        S.duration_text(seconds).alias("duration"))
    ordered = shown.orderBy(F.desc(S.instant(F.col("start_time"))), "build_id")
    return ordered.limit(limit) if limit else ordered
