"""Catalogue of experiments, runs and artifacts, derived from one frame of artifact paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanfold.functions import paths as P
from fanfold.operators.ordering import computed_once
from fanfold.session import materialize

# Experiment, run, stage directory and the directory below it; a directory has something after it.
_LAYOUT = rf"(?s)^(.*?)/({P.RUN_ID})(?:/(?:([^/]*)/(?:([^/]*)/)?)?.*)?\z"
_MARK = "\u0001"
_PIECES = _MARK.join(f"${i}" for i in range(1, 5))
_OUTPUT_DIR = r"^([0-9]{8}-[0-9]{6})(?:_(.*))?\z"


def parse_artifacts(df: DataFrame, prefix: str) -> DataFrame:
    """Each artifact below ``prefix`` with the parts of its path: the layout read backwards.

    An artifact outside a run keeps its row, with NULL parts. One regex cuts the path into an
    array from which all columns are taken.
    """
    cut = F.split(F.regexp_replace(P.below(F.col("path"), prefix), _LAYOUT, _PIECES), _MARK)
    parts = df.where(F.col("path").startswith(prefix)).withColumn("__cut", cut)
    piece = lambda i: F.nullif(F.get("__cut", F.lit(i)), F.lit(""))
    named = computed_once(
        parts, exp_id=F.when(F.size("__cut") > 1, F.get("__cut", F.lit(0))), run_id=piece(1), stage_dir=piece(2),
        __out=piece(3), file=P.basename(F.col("path")))
    output_dir = F.when(F.col("stage_dir") == "outputs", F.col("__out"))
    return named.select(
        *df.columns, "exp_id", "run_id", "stage_dir",
        F.regexp_extract("file", r"^(?:input|result)_([0-9]+)\.", 1).try_cast("int").alias("task_index"),
        F.nullif(F.regexp_extract(output_dir, _OUTPUT_DIR, 1), F.lit("")).alias("output_ts"),
        F.nullif(F.regexp_extract(output_dir, _OUTPUT_DIR, 2), F.lit("")).alias("meta_id"),
        "file",
    )


def experiment_runs(df: DataFrame, prefix: str) -> DataFrame:
    """Distinct ``(exp_id, run_id)``; copies are removed inside each task before the shuffle."""
    below = df.where(F.col("path").startswith(prefix)).select("path")
    heads = computed_once(below, __head=P.run_head(P.below(F.col("path"), prefix)))
    return heads.where("__head <> ''").select("__head").distinct().select(
        P.head_exp(F.col("__head")).alias("exp_id"), P.head_run(F.col("__head")).alias("run_id"))


def visible(exps: DataFrame, max_depth: int = 10, patterns: Sequence[str] = ("*",)) -> DataFrame:
    """Rows of experiments (``exp_id`` unique) that are not too deep and not below another one.

    Depth counts from the folder a scan for one of the patterns begins in. ``exps`` is read three times, so pass a stored or
    materialized frame.
    """
    parts = F.split("exp_id", "/")
    near = [F.concat(F.col("exp_id"), F.lit("/")).startswith(f"{start}/" if start else "")
            & (F.size(parts) - len(start.split("/") if start else []) < max_depth) for start in sorted({P.folder_part(p) for p in patterns})]
    shallow = exps.where((F.col("exp_id") != "") & P.any_of(near))
    parents = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                          lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = (shallow.where(F.size(parts) > 1)
             .select("exp_id", F.explode(parents).alias("parent")))
    hidden = above.join(shallow.select(F.col("exp_id").alias("parent")), "parent", "left_semi")
    return shallow.join(hidden.select("exp_id").distinct(), "exp_id", "left_anti")


def experiments(df: DataFrame, prefix: str, max_depth: int = 10) -> DataFrame:
    """Experiment directories; one below another experiment is hidden, as is one too deep.

    The short list of names is written once, so the artifact table is scanned once.
    """
    return visible(materialize(experiment_runs(df, prefix).select("exp_id").distinct()), max_depth)


def run_dirs(df: DataFrame, exp_path: str) -> DataFrame:
    """All direct child directories of one experiment, whatever their names."""
    prefix = exp_path.rstrip("/") + "/"
    rest = P.relative(F.col("path"), prefix)
    child = F.split(rest, "/", 2)
    return (df.where(F.col("path").startswith(prefix))
            .select(F.when(F.size(child) > 1, F.get(child, 0)).alias("run_id"))
            .where("run_id <> ''").distinct())


def expand_patterns(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """All that the given patterns stand for; their number is the caller's."""
    given = spark.createDataFrame([(p,) for p in patterns], "pattern STRING")
    return [r.p for r in given.select(F.explode(P.meanings(F.col("pattern"))).alias("p")).distinct().orderBy("p").collect()]


def glob_filter(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    return df.where(P.glob_match(F.col(column), patterns))


def match_patterns(df: DataFrame, column: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Every row with every pattern of a table that matches it: the columns of both.

    A pattern is filed by the beginning of the text before its first wildcard, at one of nine lengths. A row is looked up by
    its own beginnings of these lengths, an equi-join; the regex only sees the patterns found so. Patterns that begin
    with a wildcard are tried on every row, as they must.
    """
    start = F.regexp_extract(pattern, r"(?s)^[^*?\[]*", 0)
    filed = patterns.withColumn("__class", P.start_class(F.length(start)))
    filed = filed.withColumns({"__start": F.left(start, F.col("__class")), "__regex": P.glob_regex_of(F.col(pattern))})
    beginnings = F.array(*[F.struct(F.lit(c).alias("c"), F.substring(column, 1, c).alias("s")) for c in P.START_CLASSES])
    # A beginning that is the whole text again would be looked up in vain.
    useful = F.filter(beginnings, lambda b: F.length(b["s"]) == b["c"])
    rows = df.select("*", F.inline(F.transform(useful, lambda b: F.struct(b["c"].alias("__class"), b["s"].alias("__start")))))
    found = rows.join(filed, ["__class", "__start"]).where(F.expr(f"`{column}` rlike __regex"))
    return found.select(*df.columns, *patterns.columns)


def scan_below(df: DataFrame, prefix: str, patterns: Sequence[str]) -> DataFrame:
    """Artifacts that can belong to a matching experiment, by pushed-down path starts."""
    return df.where(P.glob_starts(F.col("path"), patterns, prefix))


def run_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("exp_id").agg(F.count("run_id").alias("n_runs")).withColumn(
        "multi_run", F.col("n_runs") > 1)


def catalog_summary(runs: DataFrame) -> DataFrame:
    """Counted per experiment first, so the global step adds up one row per experiment."""
    per_exp = runs.groupBy("exp_id").agg(F.count(F.lit(1)).alias("n"))
    return per_exp.agg(F.count(F.lit(1)).alias("n_experiments"),
                       F.coalesce(F.sum("n"), F.lit(0)).alias("n_runs"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Greatest run id of each experiment, with the number of its runs."""
    return runs.groupBy("exp_id").agg(F.max("run_id").alias("run_id"), F.count("run_id").alias("n_runs"))


def newest(runs: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest runs (0 = all), newest first, ties by experiment."""
    ordered = runs.orderBy(F.desc("run_id"), "exp_id")
    return ordered.limit(n) if n else ordered


def run_uris(runs: DataFrame, bucket: str, prefix: str, scheme: str = "gs") -> DataFrame:
    """Start time, storage address and command arguments of each run."""
    path = P.artifact_path(prefix, F.col("exp_id"), F.col("run_id"))
    return runs.select("exp_id", "run_id", P.run_ts(F.col("run_id")).alias("run_ts"),
                       F.concat(F.lit(f"{scheme}://{bucket}/"), path, F.lit("/")).alias("uri"),
                       F.format_string("--exp-id %s --run-id %s", "exp_id", "run_id").alias("args"))


def _targets(files: Sequence[str] | None) -> Column:
    return F.array(*map(F.lit, files)) if files else P.target_list(F.col("exp_id"))


def target_files(exps: DataFrame, files: Sequence[str] | None = None) -> DataFrame:
    """One row per wanted file; ``files`` replaces the rule."""
    return exps.select("*", F.explode(_targets(files)).alias("target"))


def match_outputs(artifacts: DataFrame, runs: DataFrame, patterns: Sequence[str] | None = None) -> DataFrame:
    """Files below ``outputs/`` of the given runs whose base name matches a pattern.

    ``artifacts`` is parsed; the stage test and the name test run before the join, and ``runs``
    has one row per run, so the join never multiplies rows.
    """
    outputs = artifacts.where("stage_dir = 'outputs'")
    if patterns:
        outputs = outputs.where(P.glob_match(F.col("file"), patterns))
    else:
        outputs = outputs.where(F.array_contains(P.target_list(F.col("exp_id")), F.col("file")))
    return outputs.join(runs.select("exp_id", "run_id"), ["exp_id", "run_id"], "left_semi")


def retrieval_plan(df: DataFrame, prefix: str, patterns: Sequence[str],
                   files: Sequence[str] | None = None, max_depth: int = 10) -> DataFrame:
    """Per matching experiment, at most ``max_depth`` deep in its pattern's folder: latest run, number of runs, wanted files.

    One scan gives one row per experiment; that short table is written once and the rest works on it.
    """
    found = materialize(latest_runs(experiment_runs(scan_below(df, prefix, patterns), prefix)))
    kept = glob_filter(visible(found, max_depth, patterns), "exp_id", patterns)
    return kept.select("exp_id", "run_id", "n_runs", _targets(files).alias("targets"))


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count(F.lit(1)).alias("n_experiments"),
                    F.coalesce(F.sum(F.size("targets")), F.lit(0)).alias("n_files"))


def with_destination(matched: DataFrame, long: bool = False, prefix: str = "",
                     nest_runs: bool = False) -> DataFrame:
    """``exp/[run/]file`` each match is copied to."""
    folder = [F.col("exp_id"), F.col("run_id")] if nest_runs else [F.col("exp_id")]
    return matched.withColumn(
        "destination", F.concat_ws("/", *folder, P.destination(F.col("path"), long, prefix)))


def split_existing(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Marks each planned copy ``copy``, ``skip`` (already there) or ``collision``.

    Of several sources with one destination the smallest path is copied. It is found by a partial
    aggregate and joined back on (destination, path), so a destination shared by very many sources
    is spread over all tasks.
    """
    won = _winners(plan, existing).select("destination", F.col("__first").alias("path"), "__there")
    action = (F.when(F.col("__there").isNull(), "collision")
              .when(F.col("__there"), "skip").otherwise("copy"))
    return plan.join(won, ["destination", "path"], "left").select(*plan.columns, action.alias("action"))


def _winners(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Per destination: the path to copy, the number of sources, and whether it is there already."""
    first = plan.groupBy("exp_id", "destination").agg(F.min("path").alias("__first"), F.count(F.lit(1)).alias("__n"))
    there = existing.select("destination").distinct().withColumn("__found", F.lit(True))
    return first.join(there, "destination", "left").withColumn("__there", F.coalesce("__found", F.lit(False)))


def copy_counts(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Copied, skipped and colliding files per experiment, without marking the single rows."""
    return _winners(plan, existing).groupBy("exp_id").agg(
        F.count_if(~F.col("__there")).alias("to_copy"), F.count_if(F.col("__there")).alias("skipped"),
        F.sum(F.col("__n") - 1).alias("collisions"))


def storage_usage(parsed: DataFrame, levels: Sequence[str] = ("exp_id", "run_id")) -> DataFrame:
    """Bytes and objects per level with subtotals; ``level`` counts the levels still told apart."""
    # Grouped by all levels first: the rollup then repeats one row per group, not one per artifact.
    full = parsed.groupBy(*levels).agg(F.sum("length").alias("__bytes"), F.count(F.lit(1)).alias("__objects"))
    usage = full.rollup(*levels).agg(
        F.sum("__bytes").alias("bytes"), F.sum("__objects").alias("objects"), F.grouping_id().alias("__gid"))
    depth = F.lit(len(levels)) - F.length(F.replace(F.bin("__gid"), F.lit("0"), F.lit("")))
    return usage.select(*levels, depth.cast("int").alias("level"), "bytes", "objects")


def dedupe_by_stem(files: DataFrame) -> DataFrame:
    """One YAML file per (experiment, stem); ``.yaml`` beats ``.yml``, other files are not listed."""
    stem = F.regexp_extract("file", r"(?s)^(.*)\.ya?ml\z", 1)
    return (files.where(F.col("file").rlike(r"\.ya?ml\z"))
            .groupBy("exp_id", stem.alias("stem"))
            .agg(F.max_by("file", F.col("file").endswith(".yaml")).alias("file")))
