"""Row-quality rules, scalar functions and job progression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanfold.functions import rules as Q
from fanfold.functions import scalars as S
from fanfold.plans.registry import Inputs, query
from fanfold.streaming.watch import latest_states, state_steps

NOW = "2000-01-01T00:00:00Z"
# The same odd values are made in both dialects from a key.
EXP = ("CASE k % 6 WHEN 0 THEN '  flu/' || k || ' ' WHEN 1 THEN 'a/../' || k WHEN 2 THEN 'sp ace' WHEN 3 THEN '   ' "
       "WHEN 4 THEN repeat('x', 201) ELSE 'ok-' || k END")
RUN = ("CASE k % 7 WHEN 0 THEN '20240230-101010-0123abcd' WHEN 1 THEN '20191301-101010-0123abcd' WHEN 2 THEN '20241301-101010-0123abcd' "
       "WHEN 3 THEN '20240101-256161-0123abcd' WHEN 4 THEN 'local_' || k WHEN 5 THEN 'no dots.' ELSE repeat('r', 101) END")
TOKEN = ("CASE k % 5 WHEN 0 THEN 'ghp_' || repeat('a', 36) WHEN 1 THEN 'gho_short' WHEN 2 THEN 'secret' WHEN 3 THEN '' "
         "ELSE 'github_pat_' || repeat('b', 300) END")
LABEL = "'Exp/' || n || ' #' || repeat('Z', (k % 70)::integer) || '--'"


def keyed(t: Inputs, text: str) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n")).select(
        "k", F.expr(text.replace("::integer", "")).alias("x"))


def keyed_sql(text: str) -> str:
    return f"(SELECT k, {text} AS x FROM (SELECT c_custkey AS k, c_name AS n FROM customer))"


def verdict(df: DataFrame, rule: Column, key: str = "k") -> DataFrame:
    return df.select(key, rule.alias("v")).select(
        key, "v.valid", F.coalesce("v.reason", F.lit("")).alias("reason"))


def verdict_sql(cases: list[tuple[str, str]], source: str, key: str = "k") -> str:
    chain = " ".join(f"WHEN {c} THEN '{r}'" for c, r in cases)
    return f"SELECT {key}, reason = '' AS valid, reason FROM (SELECT {key}, CASE {chain} ELSE '' END AS reason FROM {source})"


@query("q1_exp", verdict_sql([
    ("trim(x) = ''", "empty"), ("contains(x, '..')", "path traversal"),
    ("NOT regexp_full_match(trim(x), '[a-zA-Z0-9_/-]+')", "invalid characters"), ("length(trim(x)) > 200", "too long")],
    keyed_sql(EXP)))
def q1_exp(t: Inputs) -> DataFrame:
    return verdict(keyed(t, EXP), Q.check_exp_id(F.col("x")))


@query("q2_run", verdict_sql([
    ("k % 7 = 1", "year"), ("k % 7 = 2", "month"), ("k % 7 = 3", "hour"), ("k % 7 = 5", "format"), ("k % 7 = 6", "too long")],
    keyed_sql(RUN)))
def q2_run(t: Inputs) -> DataFrame:
    return verdict(keyed(t, RUN), Q.check_run_id(F.col("x")))


@query("q3_stage", """
SELECT k, reason = '' AS valid, reason FROM (SELECT k, CASE WHEN x = 'later' THEN 'unknown stage' ELSE '' END AS reason
  FROM (SELECT event_id AS k, CASE event_id % 4 WHEN 0 THEN ' A ' WHEN 1 THEN 'Runner' WHEN 2 THEN 'output' ELSE 'later' END AS x FROM events))
""")
def q3_stage(t: Inputs) -> DataFrame:
    x = F.expr("CASE event_id % 4 WHEN 0 THEN ' A ' WHEN 1 THEN 'Runner' WHEN 2 THEN 'output' ELSE 'later' END")
    return verdict(t.events.select(F.col("event_id").alias("k"), x.alias("x")), Q.check_stage(F.col("x")))


@query("q4_label", f"""
SELECT k, trim(substr(lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}_-]', '-', 'g')), 1, 63), '-_') AS label FROM {keyed_sql(LABEL)}
""")
def q4_label(t: Inputs) -> DataFrame:
    return keyed(t, LABEL).select("k", Q.sanitize_label(F.col("x")).alias("label"))


@query("q5_token", verdict_sql([
    ("x = ''", "empty"), ("NOT regexp_matches(x, '^(github_pat_|ghp_|gho_|ghu_|ghs_|ghr_)')", "prefix"),
    ("length(x) < 20 OR length(x) > 300", "length")], keyed_sql(TOKEN)))
def q5_token(t: Inputs) -> DataFrame:
    return verdict(keyed(t, TOKEN), Q.check_token(F.col("x")))


@query("q5_flag", """
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '^(github_pat_|ghp_|gho_|ghu_|ghs_|ghr_)')
  AND length(w) BETWEEN 20 AND 300)) > 0 AS has_token
FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || ' ghp_' || repeat('a', (doc_id % 40)::integer) || ' end' ELSE text END AS text FROM documents)
""")
def q5_flag(t: Inputs) -> DataFrame:
    planted = F.expr("CASE WHEN doc_id % 9 = 0 THEN text || ' ghp_' || repeat('a', cast(doc_id % 40 AS int)) || ' end' ELSE text END")
    return t.documents.select("doc_id", Q.token_flag(planted).alias("has_token"))


@query("q6_machine", """
SELECT machine_key AS k, reason = '' AS valid, reason FROM (
  SELECT machine_key, CASE WHEN regexp_full_match(x, '[a-z0-9]+-[a-z0-9-]+') THEN '' ELSE 'format' END AS reason
  FROM (SELECT machine_key, CASE WHEN machine_key % 2 = 0 THEN replace(lower(machine_type), '#', '') ELSE machine_type END AS x FROM fx_prices))
""", "fx_prices")
def q6_machine(t: Inputs) -> DataFrame:
    x = F.when(F.col("machine_key") % 2 == 0, F.replace(F.lower("machine_type"), F.lit("#"), F.lit(""))).otherwise(F.col("machine_type"))
    return verdict(t.fx("fx_prices").select(F.col("machine_key").alias("k"), x.alias("x")), Q.check_machine(F.col("x")))


# --- functions ---------------------------------------------------------------------------------

ISO = ("CASE k % 4 WHEN 0 THEN iso || 'Z' WHEN 1 THEN iso || '.123456+02:00' WHEN 2 THEN 'unreadable ' || iso ELSE 'short' END")


def stamped(t: Inputs) -> DataFrame:
    iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    return t.events.select(F.col("event_id").alias("k"), iso.alias("iso")).select("k", F.expr(ISO).alias("x"))


STAMPED = f"(SELECT k, x FROM (SELECT k, {ISO} AS x FROM (SELECT event_id AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events)))"


@query("f1_full", f"""
SELECT k, CASE WHEN k % 4 < 2 THEN replace(substr(x, 1, 19), 'T', ' ') ELSE substr(x, 1, 19) END AS shown FROM {STAMPED}
""")
def f1_full(t: Inputs) -> DataFrame:
    return stamped(t).select("k", S.fmt_full(F.col("x")).alias("shown"))


@query("f2_time", f"""
SELECT k, CASE WHEN length(x) >= 19 THEN substr(x, 12, 8) ELSE x END AS shown FROM {STAMPED}
""")
def f2_time(t: Inputs) -> DataFrame:
    return stamped(t).select("k", S.fmt_time(F.col("x")).alias("shown"))


@query("f3_local", f"""
SELECT k, CASE k % 4 WHEN 0 THEN strftime(replace(x, 'Z', '')::timestamp + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') || ' JST'
  WHEN 1 THEN strftime(substr(x, 1, 19)::timestamp + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') || ' JST' ELSE substr(x, 1, 19) END AS shown FROM {STAMPED}
""")
def f3_local(t: Inputs) -> DataFrame:
    return stamped(t).select("k", S.fmt_local(F.col("x"), "Asia/Tokyo").alias("shown"))


# Seconds from 0 to about twelve days, some negative.
@query("f5_text", """
SELECT k, CASE WHEN s < 0 THEN '0s' WHEN s < 60 THEN s || 's'
  WHEN s < 3600 THEN (s // 60) || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || (s % 60) || 's' ELSE '' END
  WHEN s < 86400 THEN (s // 3600) || 'h' || CASE WHEN s % 3600 // 60 > 0 THEN ' ' || (s % 3600 // 60) || 'm' ELSE '' END
  ELSE (s // 86400) || 'd' || CASE WHEN s % 86400 // 3600 > 0 THEN ' ' || (s % 86400 // 3600) || 'h' ELSE '' END END AS shown
FROM (SELECT c_custkey AS k, cast(round(c_acctbal * c_acctbal / 100) AS bigint) * sign(c_acctbal)::bigint AS s FROM customer)
""")
def f5_text(t: Inputs) -> DataFrame:
    s = F.round(F.col("c_acctbal") * F.col("c_acctbal") / 100).cast("bigint") * F.sign("c_acctbal").cast("bigint")
    return t.customer.select(F.col("c_custkey").alias("k"), S.duration_text(s).alias("shown"))


SPAN = "CASE k % 6 WHEN 0 THEN k || 'h' WHEN 1 THEN k || 'm' WHEN 2 THEN k || 'd' WHEN 3 THEN k || 's' WHEN 4 THEN 'x' || k || 'h' ELSE k || '' END"
SPAN_SECONDS = "CASE k % 6 WHEN 0 THEN k * 3600 WHEN 1 THEN k * 60 WHEN 2 THEN k * 86400 WHEN 3 THEN k ELSE {other} END"


@query("f6_since", f"""
SELECT k, CASE WHEN k % 6 < 4 THEN substr(cast(TIMESTAMP '2000-01-01' - to_seconds({SPAN_SECONDS.format(other='0')}) AS string), 1, 19)
  ELSE '' END AS moment FROM {keyed_sql(SPAN)}
""")
def f6_since(t: Inputs) -> DataFrame:
    return keyed(t, SPAN).select("k", F.coalesce(S.since(F.col("x"), NOW).cast("string"), F.lit("")).alias("moment"))


@query("f7_parse", f"SELECT k, {SPAN_SECONDS.format(other='-1')} AS seconds FROM {keyed_sql(SPAN)}")
def f7_parse(t: Inputs) -> DataFrame:
    return keyed(t, SPAN).select("k", F.coalesce(S.duration_parse(F.col("x")), F.lit(-1)).alias("seconds"))


@query("f9_severity", """
SELECT insert_id, CASE severity WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' WHEN 'INFO' THEN 'info' ELSE 'debug' END AS class
FROM fx_logs
""", "fx_logs")
def f9_severity(t: Inputs) -> DataFrame:
    return t.fx("fx_logs").select("insert_id", S.severity_class(F.col("severity")).alias("class"))


@query("f10_run_id", """
SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d-%H%M%S') || '-' || lpad(lower(hex(o_orderkey)), 8, '0') AS run_id FROM orders
""")
def f10_run_id(t: Inputs) -> DataFrame:
    execution = F.concat(F.lpad(F.lower(F.hex("o_orderkey")), 8, "0"), F.lit("-0000"))
    return t.orders.select("o_orderkey", S.make_run_id(F.col("o_orderdate"), execution).alias("run_id"))


# --- progression -------------------------------------------------------------------------------


@query("w3_steps", """
SELECT job_id, coalesce(prev, 'none') AS from_state, state AS to_state, substr(cast(ts AS string), 1, 19) AS ts FROM (
  SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY ts, state) AS prev FROM fx_job_events)
WHERE prev IS DISTINCT FROM state
""", "fx_job_events")
def w3_steps(t: Inputs) -> DataFrame:
    steps = state_steps(t.fx("fx_job_events").withColumn("ts", F.col("ts").cast("timestamp")))
    return steps.select("job_id", F.coalesce("from_state", F.lit("none")).alias("from_state"), "to_state",
                        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("w2_latest", """
SELECT job_id, max_by(state, ts) AS state, max_by(state, ts) IN ('SUCCEEDED', 'FAILED') AS terminal FROM fx_job_events GROUP BY job_id
""", "fx_job_events")
def w2_latest(t: Inputs) -> DataFrame:
    events = t.fx("fx_job_events").withColumn("ts", F.col("ts").cast("timestamp"))
    return latest_states(events).select("job_id", "state", "terminal")
