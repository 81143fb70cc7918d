"""Catalogue queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanfold.functions import paths as P
from fanfold.operators import catalog as C
from fanfold.plans.registry import Inputs, query
from fanfold.session import materialize, shared_dir
from fanfold.sources.catalogue import read_catalogue, write_catalogue

PREFIX = "pipeline/flu/"
GLOBS = ["1995*/hosp_*", "199[67]??/ed_1*", "199804/ed_[!0-8]"]
RUN = "[0-9]{8}-[0-9]{6}-[a-f0-9]{8}"
REPORTS = "('posterior_grid.pdf', 'quantiles_grid_sidebyside.pdf')"

# Pieces of SQL shared by the checks below.
RUNS_SQL = f"""runs AS (
  SELECT DISTINCT regexp_extract(substr(path, 14), '^(.*?)/({RUN})/', 1) AS exp_id,
    regexp_extract(substr(path, 14), '^(.*?)/({RUN})/', 2) AS run_id FROM fx_artifacts)"""
PARSED_SQL = f"""parsed AS (
  SELECT path, length, regexp_extract(path, '^pipeline/flu/(.*?)/({RUN})/', 1) AS exp_id,
    regexp_extract(path, '^pipeline/flu/(.*?)/({RUN})/', 2) AS run_id,
    string_split(path, '/')[6] AS stage_dir, string_split(path, '/')[-1] AS file FROM fx_artifacts)"""
GLOB_SQL = " OR ".join(f"exp_id GLOB '{g}'" for g in GLOBS)
MATCH_SQL = f"""matched AS (
  SELECT p.* FROM parsed p JOIN (SELECT exp_id, max(run_id) AS run_id FROM runs GROUP BY 1) l USING (exp_id, run_id)
  WHERE stage_dir = 'outputs' AND (file IN {REPORTS}
    OR (file = 'categorical_rate_trends.pdf' AND string_split(exp_id, '/')[-1] LIKE 'hosp\\_%' ESCAPE '\\')))"""


def artifacts(t: Inputs) -> DataFrame:
    return t.fx("fx_artifacts")


def runs(t: Inputs) -> DataFrame:
    return C.experiment_runs(artifacts(t), PREFIX)


def runs_below(t: Inputs, patterns: list[str]) -> DataFrame:
    """Runs of artifacts that can match one of the patterns."""
    return C.experiment_runs(C.scan_below(artifacts(t), PREFIX, patterns), PREFIX)


def matched(t: Inputs) -> DataFrame:
    parsed = C.parse_artifacts(artifacts(t), PREFIX)
    return C.match_outputs(parsed, C.latest_runs(runs(t))).select("exp_id", "run_id", "path")


@query("s2_path", """
SELECT run_key, task_index, 'pipeline/flu/exp' || cast(run_key % 10 AS string) || '/run-' || cast(run_key AS string) ||
  '/runner-artifacts/result_' || lpad(cast(task_index AS string), 5, '0') || '.pkl.gz' AS path FROM fx_results
""", "fx_results")
def s2_path(t: Inputs) -> DataFrame:
    exp = F.concat(F.lit("exp"), F.col("run_key") % 10)
    run = F.concat(F.lit("run-"), F.col("run_key"))
    file = P.task_file("result", F.col("task_index"))
    return t.fx("fx_results").select("run_key", "task_index", P.artifact_path(
        PREFIX, exp, run, "runner-artifacts", file).alias("path"))


@query("s11_content_type", """
SELECT path, CASE WHEN path LIKE '%.gz' THEN 'application/gzip' WHEN path LIKE '%.pdf' THEN 'application/pdf'
  ELSE 'application/octet-stream' END AS content_type FROM fx_artifacts
""", "fx_artifacts")
def s11_content_type(t: Inputs) -> DataFrame:
    return artifacts(t).select("path", P.content_type(F.col("path")).alias("content_type"))


@query("c1_parse", f"""
WITH {PARSED_SQL} SELECT path, length, exp_id, run_id, stage_dir,
  coalesce(try_cast(regexp_extract(file, '^(input|result)_([0-9]+)', 2) AS integer), -1) AS task_index,
  CASE WHEN stage_dir = 'outputs' THEN substr(string_split(path, '/')[7], 1, 15) ELSE '' END AS output_ts,
  CASE WHEN stage_dir = 'outputs' AND length(string_split(path, '/')[7]) > 15
    THEN substr(string_split(path, '/')[7], 17) ELSE '' END AS meta_id, file FROM parsed
""", "fx_artifacts")
def c1_parse(t: Inputs) -> DataFrame:
    return C.parse_artifacts(artifacts(t), PREFIX).na.fill(-1, ["task_index"]).na.fill("", ["output_ts", "meta_id"])


@query("c2_runs", f"WITH {RUNS_SQL} SELECT exp_id, run_id FROM runs", "fx_artifacts")
def c2_runs(t: Inputs) -> DataFrame:
    return runs(t)


# Every fifth experiment also gets a run directory one level up, which hides what lies below it.
NESTED_SQL = r"""nested AS (
  SELECT path FROM fx_artifacts WHERE length % 3 <> 0
  UNION ALL SELECT regexp_replace(path, '^(pipeline/flu/[0-9]{5}[05])/[^/]+/', '\1/') AS path
  FROM fx_artifacts WHERE length % 3 = 0)"""


@query("c3_experiments", f"""
WITH {NESTED_SQL}, exps AS (
  SELECT DISTINCT regexp_extract(substr(path, 14), '^(.*?)/({RUN})/', 1) AS exp_id FROM nested)
SELECT exp_id FROM exps e WHERE NOT EXISTS (SELECT 1 FROM exps p WHERE e.exp_id LIKE p.exp_id || '/%')
""", "fx_artifacts")
def c3_experiments(t: Inputs) -> DataFrame:
    shorter = F.regexp_replace("path", "^(pipeline/flu/[0-9]{5}[05])/[^/]+/", "$1/")
    up = F.when(F.col("length") % 3 == 0, shorter).otherwise(F.col("path"))
    return C.experiments(artifacts(t).withColumn("path", up), PREFIX)


@query("c4_run_dirs", """
SELECT DISTINCT string_split(path, '/')[5] AS run_id FROM fx_artifacts
WHERE starts_with(path, 'pipeline/flu/199504/ed_3/')
""", "fx_artifacts")
def c4_run_dirs(t: Inputs) -> DataFrame:
    return C.run_dirs(artifacts(t), f"{PREFIX}199504/ed_3")


@query("c5_glob", f"WITH {RUNS_SQL} SELECT exp_id, run_id FROM runs WHERE {GLOB_SQL}", "fx_artifacts")
def c5_glob(t: Inputs) -> DataFrame:
    return C.glob_filter(runs_below(t, GLOBS), "exp_id", GLOBS)


PATTERN_SQL = """patterns AS (
  SELECT DISTINCT CASE c_custkey % 11 WHEN 0 THEN '*_' || substr(place, 6, 1) ELSE place || CASE c_custkey % 4 WHEN 0 THEN '/hosp_1*'
    WHEN 1 THEN '/ed_[!1-8]' WHEN 2 THEN '/*_?' ELSE '/ed_' || cast(c_custkey % 20 AS string) END END AS pattern
  FROM (SELECT c_custkey, cast(199201 + c_custkey % 7 * 100 + c_custkey % 12 AS string) AS place FROM {customer}) p)"""


@query("c5_table", f"""
WITH {RUNS_SQL}, {PATTERN_SQL.format(customer="customer")}
SELECT pattern, count(*) AS n_runs, count(DISTINCT exp_id) AS n_exps FROM runs JOIN patterns ON exp_id GLOB pattern GROUP BY pattern
""", "fx_artifacts")
def c5_table(t: Inputs) -> DataFrame:
    """Some hundred patterns in a table, each with the runs that it matches."""
    patterns = t.sql(f"WITH {PATTERN_SQL} SELECT pattern FROM patterns")
    return C.match_patterns(runs(t), "exp_id", patterns).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_distinct("exp_id").alias("n_exps"))


@query("c6_patterns", f"""
WITH {RUNS_SQL} SELECT exp_id, run_id FROM runs
WHERE exp_id = '199501' OR starts_with(exp_id, '199501/') OR exp_id = '199602' OR starts_with(exp_id, '199602/')
  OR exp_id GLOB '*/hosp_1'
""", "fx_artifacts")
def c6_patterns(t: Inputs) -> DataFrame:
    wanted = C.expand_patterns(t.spark, ["199501", "199602/", "*/hosp_1"])
    return C.glob_filter(runs_below(t, wanted), "exp_id", wanted)


@query("c7_pruned", f"""
WITH {RUNS_SQL} SELECT exp_id, run_id FROM runs WHERE exp_id GLOB '1995*/hosp_*' OR exp_id GLOB '199804/ed_[1-4]'
""", "fx_artifacts")
def c7_pruned(t: Inputs) -> DataFrame:
    """A catalogue stored in stretches of paths, of which only those with the patterns' starts are opened."""
    patterns, root = ["1995*/hosp_*", "199804/ed_[1-4]"], f"{shared_dir(t.spark)}/stored-{uuid.uuid4().hex}"
    write_catalogue(artifacts(t), root, 16)
    near = read_catalogue(t.spark, root, PREFIX, patterns)
    return C.glob_filter(C.experiment_runs(near, PREFIX), "exp_id", patterns)


@query("c8_run_ts", f"""
WITH {RUNS_SQL} SELECT run_id, substr(cast(try_strptime(substr(run_id, 1, 15), '%Y%m%d-%H%M%S') AS string), 1, 19) AS run_ts
FROM runs
""", "fx_artifacts")
def c8_run_ts(t: Inputs) -> DataFrame:
    return runs(t).select("run_id", P.run_ts(F.col("run_id")).cast("string").alias("run_ts"))


@query("c9_run_counts", f"""
WITH {RUNS_SQL} SELECT exp_id, count(*) AS n_runs, count(*) > 1 AS multi_run FROM runs GROUP BY exp_id
""", "fx_artifacts")
def c9_run_counts(t: Inputs) -> DataFrame:
    return C.run_counts(runs(t))


@query("c10_summary", f"""
WITH {RUNS_SQL} SELECT count(DISTINCT exp_id) AS n_experiments, count(*) AS n_runs FROM runs
""", "fx_artifacts")
def c10_summary(t: Inputs) -> DataFrame:
    return C.catalog_summary(runs(t))


@query("c11_latest", f"""
WITH {RUNS_SQL} SELECT exp_id, max(run_id) AS run_id, count(*) AS n_runs FROM runs GROUP BY exp_id
""", "fx_artifacts")
def c11_latest(t: Inputs) -> DataFrame:
    return C.latest_runs(runs(t))


@query("c12_newest", f"""
WITH {RUNS_SQL} SELECT exp_id, run_id FROM runs ORDER BY run_id DESC, exp_id LIMIT 20
""", "fx_artifacts")
def c12_newest(t: Inputs) -> DataFrame:
    return C.newest(runs(t), 20)


@query("c13_uris", f"""
WITH {RUNS_SQL} SELECT exp_id, run_id, 'gs://bucket/pipeline/flu/' || exp_id || '/' || run_id || '/' AS uri,
  '--exp-id ' || exp_id || ' --run-id ' || run_id AS args,
  strftime(strptime(substr(run_id, 1, 15), '%Y%m%d-%H%M%S'), '%Y-%m-%d %H:%M:%S') AS run_ts FROM runs
""", "fx_artifacts")
def c13_uris(t: Inputs) -> DataFrame:
    return C.run_uris(runs(t), "bucket", PREFIX).withColumn("run_ts", F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss"))


@query("c14_targets", f"""
WITH {RUNS_SQL}, exps AS (SELECT DISTINCT exp_id FROM runs)
SELECT exp_id, unnest(['posterior_grid.pdf', 'quantiles_grid_sidebyside.pdf']) AS target FROM exps
UNION ALL SELECT exp_id, 'categorical_rate_trends.pdf' FROM exps
WHERE starts_with(string_split(exp_id, '/')[-1], 'hosp_')
""", "fx_artifacts")
def c14_targets(t: Inputs) -> DataFrame:
    return C.target_files(C.experiments(artifacts(t), PREFIX))


@query("c15_match", f"WITH {RUNS_SQL}, {PARSED_SQL}, {MATCH_SQL} SELECT exp_id, run_id, path FROM matched",
       "fx_artifacts")
def c15_match(t: Inputs) -> DataFrame:
    return matched(t)


@query("c15_patterns", f"""
WITH {PARSED_SQL} SELECT exp_id, run_id, path FROM parsed
WHERE stage_dir = 'outputs' AND (file GLOB 'posterior*.pdf' OR file GLOB '*.csv.gz')
""", "fx_artifacts")
def c15_patterns(t: Inputs) -> DataFrame:
    parsed = C.parse_artifacts(artifacts(t), PREFIX)
    return C.match_outputs(parsed, runs(t), ["posterior*.pdf", "*.csv.gz"]).select("exp_id", "run_id", "path")


@query("c16_plan", f"""
WITH {RUNS_SQL} SELECT exp_id, max(run_id) AS run_id, count(*) AS n_runs,
  CASE WHEN starts_with(string_split(exp_id, '/')[-1], 'hosp_') THEN 3 ELSE 2 END AS n_files
FROM runs WHERE {GLOB_SQL} GROUP BY exp_id
""", "fx_artifacts")
def c16_plan(t: Inputs) -> DataFrame:
    plan = C.retrieval_plan(artifacts(t), PREFIX, GLOBS)
    return plan.select("exp_id", "run_id", "n_runs", F.size("targets").alias("n_files"))


@query("c16_totals", f"""
WITH {RUNS_SQL} SELECT count(*) AS n_experiments,
  sum(CASE WHEN starts_with(string_split(exp_id, '/')[-1], 'hosp_') THEN 3 ELSE 2 END)::bigint AS n_files
FROM (SELECT DISTINCT exp_id FROM runs WHERE {GLOB_SQL})
""", "fx_artifacts")
def c16_totals(t: Inputs) -> DataFrame:
    return C.plan_totals(C.retrieval_plan(artifacts(t), PREFIX, GLOBS))


@query("c17_names", """
SELECT path, string_split(path, '/')[-1] AS short_name, replace(substr(path, 14), '/', '_') AS long_name FROM fx_artifacts
""", "fx_artifacts")
def c17_names(t: Inputs) -> DataFrame:
    path = F.col("path")
    return artifacts(t).select("path", P.destination(path).alias("short_name"),
                               P.destination(path, long=True, prefix=PREFIX).alias("long_name"))


# All runs go to one folder per experiment, so short names meet; a third of the folder is there already.
@query("c18_incremental", f"""
WITH {RUNS_SQL}, {PARSED_SQL}, m AS (
  SELECT exp_id, exp_id || '/' || file AS destination, path FROM parsed WHERE stage_dir = 'outputs'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY destination ORDER BY path) AS nth FROM m)
SELECT exp_id, sum(CASE WHEN nth = 1 AND length(destination) % 3 <> 0 THEN 1 ELSE 0 END)::bigint AS to_copy,
  sum(CASE WHEN nth = 1 AND length(destination) % 3 = 0 THEN 1 ELSE 0 END)::bigint AS skipped,
  sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END)::bigint AS collisions FROM ranked GROUP BY exp_id
""", "fx_artifacts")
def c18_incremental(t: Inputs) -> DataFrame:
    outputs = C.parse_artifacts(artifacts(t), PREFIX).where("stage_dir = 'outputs'")
    plan = C.with_destination(outputs.select("exp_id", "run_id", "path"))
    there = plan.where(F.length("destination") % 3 == 0).select("destination")
    return C.copy_counts(plan, there)


@query("c18_actions", f"""
WITH {RUNS_SQL}, {PARSED_SQL}, m AS (
  SELECT exp_id, exp_id || '/' || file AS destination, path FROM parsed WHERE stage_dir = 'outputs')
SELECT destination, path, CASE WHEN path <> min(path) OVER (PARTITION BY destination) THEN 'collision'
  WHEN length(destination) % 3 = 0 THEN 'skip' ELSE 'copy' END AS action FROM m
""", "fx_artifacts")
def c18_actions(t: Inputs) -> DataFrame:
    outputs = C.parse_artifacts(artifacts(t), PREFIX).where("stage_dir = 'outputs'")
    plan = C.with_destination(outputs.select("exp_id", "run_id", "path"))
    there = plan.where(F.length("destination") % 3 == 0).select("destination")
    return C.split_existing(plan, there).select("destination", "path", "action")


@query("c19_usage", f"""
WITH {PARSED_SQL} SELECT coalesce(exp_id, '') AS exp_id, coalesce(run_id, '') AS run_id, CASE WHEN grouping(parsed.exp_id) = 1 THEN 0 WHEN grouping(parsed.run_id) = 1 THEN 1 ELSE 2 END AS level,
  sum(length)::bigint AS bytes, count(*) AS objects FROM parsed GROUP BY ROLLUP (parsed.exp_id, parsed.run_id)
""", "fx_artifacts")
def c19_usage(t: Inputs) -> DataFrame:
    return C.storage_usage(C.parse_artifacts(artifacts(t), PREFIX)).na.fill("", ["exp_id", "run_id"])


@query("c20_stem", """
SELECT exp_id, regexp_replace(file, '[.]ya?ml$', '') AS stem, min(file) AS file FROM fx_configs GROUP BY 1, 2
""", "fx_configs")
def c20_stem(t: Inputs) -> DataFrame:
    return C.dedupe_by_stem(t.fx("fx_configs"))


@query("flagship", f"""
WITH {RUNS_SQL}, present AS (SELECT run_key, task_index FROM fx_results WHERE status = 'ok'),
latest AS (SELECT exp_id, max(run_id) AS run_id, count(*) AS n_runs FROM runs WHERE {GLOB_SQL} GROUP BY exp_id),
ok AS (SELECT lpad(lower(hex(run_key)), greatest(8, length(hex(run_key)))::integer, '0') AS key, count(*) AS n_ok FROM present GROUP BY 1)
SELECT exp_id, run_id, n_runs, cast(coalesce(n_ok, 0) AS string) || '/7' AS completeness
FROM latest LEFT JOIN ok ON ok.key = substr(run_id, 17)
ORDER BY run_id DESC, exp_id LIMIT 50
""", "fx_artifacts", "fx_results")
def flagship(t: Inputs) -> DataFrame:
    """Latest run of every experiment matching a glob, its number of runs and its completeness; only the newest are gathered."""
    from fanfold.operators import tasks as K

    latest = C.newest(C.latest_runs(C.glob_filter(runs_below(t, GLOBS), "exp_id", GLOBS)), 50)
    shown = materialize(latest.withColumn("run_key", F.conv(F.substring("run_id", 17, P.TEXT_END), 16, 10).cast("bigint")))
    # A run id may be of several experiments; the few keys are listed once.
    wanted = shown.select("run_key").distinct()
    done = K.completeness(t.fx("fx_results").join(wanted, "run_key", "left_semi"), t.fx("fx_runs").join(wanted, "run_key", "left_semi"))
    return shown.join(done.select("run_key", "completeness"), "run_key", "left").select("exp_id", "run_id", "n_runs", "completeness")
