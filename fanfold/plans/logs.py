"""Log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanfold.functions import scalars as S
from fanfold.operators import logs as L
from fanfold.plans.registry import Inputs, query

NOW = "2024-01-31T00:00:00Z"
UID = "'stage-' || substr('abc', 1 + (task_index % 3)::integer, 1) || '-' || lpad(lower(hex(task_index)), 8, '0') || '-x'"


def logs(t: Inputs) -> DataFrame:
    """Entries as exported: labels in a map, a real instant as time."""
    uid = F.concat(F.lit("stage-"), F.substring(F.lit("abc"), F.col("task_index") % 3 + 1, F.lit(1)), F.lit("-"),
                   F.lpad(F.lower(F.hex("task_index")), 8, "0"), F.lit("-x"))
    labels = {"stage": F.col("stage"), "batch.task_index": F.col("task_index").cast("string"), "job_uid": uid,
              "exp_id": F.concat(F.lit("flu-exp-"), F.col("task_index") % 4), "run_id": F.lit("run-1"),
              "execution_id": F.lpad(F.lower(F.hex("task_index")), 8, "0")}
    return t.fx("fx_logs").select(
        "insert_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "severity", "text_payload",
        "json_payload", F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), v)]).alias("labels"),
        F.when(F.col("insert_id") % 5 == 0, L.ORCHESTRATOR_RESOURCE).otherwise(L.BATCH_RESOURCE).alias("resource_type"),
        F.create_map(F.lit("workflow_id"), F.lit("w"), F.lit("location"), F.lit("l")).alias("resource_labels"),
        "task_index")


def ids(df: DataFrame) -> DataFrame:
    return df.select("insert_id", "severity")


@query("l1_filter", """
SELECT insert_id, severity FROM fx_logs WHERE insert_id % 5 <> 0 AND task_index % 4 = 2 AND stage = 'runner'
  AND severity = 'INFO' AND timestamp >= TIMESTAMP '2024-01-03 12:00:00'
""", "fx_logs")
def l1_filter(t: Inputs) -> DataFrame:
    return ids(L.filter_logs(logs(t), resource=L.BATCH_RESOURCE, exp_id="flu/exp 2", run_id="run-1", stage="B",
                             severity="INFO", since="2024-01-03T12:00:00Z"))


@query("l1_job", f"SELECT insert_id, severity FROM fx_logs WHERE starts_with({UID}, 'stage-b-0000000')", "fx_logs")
def l1_job(t: Inputs) -> DataFrame:
    return ids(L.filter_logs(logs(t), job="stage-b-0000000"))


@query("l1_task", "SELECT insert_id, severity FROM fx_logs WHERE task_index = 7", "fx_logs")
def l1_task(t: Inputs) -> DataFrame:
    return ids(L.filter_logs(logs(t), task_index=7))


@query("l2_severity", "SELECT insert_id, severity FROM fx_logs WHERE severity = 'WARNING'", "fx_logs")
def l2_severity(t: Inputs) -> DataFrame:
    return ids(L.filter_logs(logs(t), severity="WARNING"))


@query("l3_stage", "SELECT stage, CASE stage WHEN 'builder' THEN 'A' WHEN 'runner' THEN 'B' ELSE 'C' END AS letter, "
       "count(*) AS n FROM fx_logs GROUP BY ALL", "fx_logs")
def l3_stage(t: Inputs) -> DataFrame:
    stage = L.label("stage")
    return logs(t).groupBy(stage.alias("stage"), S.stage_letter(stage).alias("letter")).agg(F.count(F.lit(1)).alias("n"))


@query("l4_execution", f"SELECT insert_id, severity FROM fx_logs WHERE substr({UID}, 9, 8) = '0000000a'", "fx_logs")
def l4_execution(t: Inputs) -> DataFrame:
    return ids(L.filter_logs(logs(t), execution="0000000a-1111-2222"))


@query("l5_fresh", "SELECT insert_id, severity FROM fx_logs WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 29 DAY",
       "fx_logs")
def l5_fresh(t: Inputs) -> DataFrame:
    return ids(L.fresh(logs(t), NOW, days=29))


@query("l6_tail", "SELECT insert_id, severity FROM fx_logs ORDER BY timestamp DESC, insert_id DESC LIMIT 100", "fx_logs")
def l6_tail(t: Inputs) -> DataFrame:
    return ids(L.tail(logs(t), 100))


MESSAGE = """CASE WHEN text_payload <> '' THEN text_payload ELSE coalesce(json_payload->>'$.message', json_payload, '') END"""


@query("l7_message", f"SELECT insert_id, {MESSAGE} AS message FROM fx_logs", "fx_logs")
def l7_message(t: Inputs) -> DataFrame:
    return logs(t).select("insert_id", L.log_message(F.col("text_payload"), F.col("json_payload")).alias("message"))


@query("l7_lines", "SELECT doc_id, md5(replace(replace(text, chr(10), ' '), chr(13), ' ')) AS message FROM documents")
def l7_lines(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", F.md5(L.log_message(F.col("text"), F.lit(None).cast("string"))).alias("message"))


@query("l8_context", "SELECT insert_id, ' [stage=' || stage || ', task=' || task_index || ']' AS context FROM fx_logs",
       "fx_logs")
def l8_context(t: Inputs) -> DataFrame:
    return logs(t).select("insert_id", L.log_context(L.label("stage"), L.label("batch.task_index")).alias("context"))


@query("l9_structured", """
SELECT insert_id, severity, stage, task_index::integer AS task_index, 'event' AS message, cast(round(value * 100) AS bigint)::string AS extra
FROM fx_logs
""", "fx_logs")
def l9_structured(t: Inputs) -> DataFrame:
    fields = F.struct("severity", "stage", "task_index", F.lit("event").alias("message"),
                      F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    parsed = t.fx("fx_logs").select("insert_id", L.parse_json_line(F.to_json(fields)).alias("p"))
    return parsed.select("insert_id", "p.severity", "p.stage", "p.task_index", "p.message",
                         F.col("p.extras")["cents"].alias("extra"))


@query("l10_console", """
SELECT insert_id, substr(cast(timestamp AS string), 1, 19) AS ts, stage, severity,
  CASE WHEN insert_id % 2 = 0 THEN task_index::integer ELSE -1 END AS task_index, 'event ' || insert_id AS message FROM fx_logs
""", "fx_logs")
def l10_console(t: Inputs) -> DataFrame:
    task = F.when(F.col("insert_id") % 2 == 0, F.format_string("[Task %d] ", "task_index")).otherwise("")
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    line = F.concat(F.concat_ws(" ", stamp, "stage", "severity", task), F.lit("event "), "insert_id")
    line = F.regexp_replace(line, " (\\[Task [0-9]+\\])? +event", " $1 event")
    line = F.regexp_replace(line, "  +", " ")
    parsed = t.fx("fx_logs").select("insert_id", L.parse_console_line(line).alias("p"))
    return parsed.select("insert_id", "p.*").na.fill(-1, ["task_index"])


@query("l11_errors", """
SELECT stage AS failed_stage, text_payload AS error_type, count(*) AS n FROM fx_logs WHERE severity = 'ERROR' GROUP BY ALL
""", "fx_logs")
def l11_errors(t: Inputs) -> DataFrame:
    records = t.fx("fx_logs").select("severity", F.col("stage").alias("failed_stage"),
                                     F.col("text_payload").alias("error_type"))
    return L.error_counts(records)


@query("l12_orchestrator", "SELECT insert_id, severity FROM fx_logs WHERE insert_id % 5 = 0 AND task_index = 3", "fx_logs")
def l12_orchestrator(t: Inputs) -> DataFrame:
    return ids(L.orchestrator_logs(logs(t), "w", "l", "00000003"))
