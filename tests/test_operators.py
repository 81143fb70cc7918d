"""Operators on small hand-made tables and by brute force."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fanfold.operators import catalog as C
from fanfold.operators import configs as G
from fanfold.operators import cost as K
from fanfold.operators import jobs as J
from fanfold.operators import logs as L
from fanfold.operators import metrics as V
from fanfold.operators import ordering as O
from fanfold.operators import results as R
from fanfold.operators import tasks as T
from fanfold.session import materialize

RUN_A, RUN_B = "20260101-000000-aaaaaaaa", "20260102-000000-bbbbbbbb"


def paths(spark, *texts):
    return spark.createDataFrame([(f"p/{t}", 1) for t in texts], "path STRING, length BIGINT")


# --- catalogue ---------------------------------------------------------------------------------


def test_nested_experiments_are_hidden_but_their_runs_are_listed(spark, rows):
    df = paths(spark, f"e/{RUN_A}/x", f"e/sub/{RUN_B}/x", f"f/g/{RUN_A}/x", f"{RUN_A}/x")
    assert rows(C.experiments(df, "p/")) == [("e",), ("f/g",)]
    assert rows(C.experiment_runs(df, "p/")) == [("e", RUN_A), ("e/sub", RUN_B), ("f/g", RUN_A)]


def test_depth_limit(spark, rows):
    deep = "/".join("abcdefghij")
    df = paths(spark, f"{deep}/{RUN_A}/x", f"{deep[:-2]}/{RUN_A}/x")
    assert rows(C.experiments(df, "p/")) == [(deep[:-2],)]


def test_run_dirs_are_not_filtered_by_name(spark, rows):
    df = paths(spark, f"e/{RUN_A}/x", "e/local/x/y", "e/file", "ee/other/x")
    assert rows(C.run_dirs(df, "p/e")) == [(RUN_A,), ("local",)]


def test_empty_listing(spark):
    df = paths(spark).limit(0)
    assert C.experiments(df, "p/").count() == 0
    assert C.catalog_summary(C.experiment_runs(df, "p/")).collect()[0].asDict() == {"n_experiments": 0, "n_runs": 0}


def test_parse_keeps_artifacts_outside_runs(spark, rows):
    df = paths(spark, f"e/{RUN_A}/outputs/20260101-000000_m1/t.csv.gz", f"e/{RUN_A}/log", "readme", f"e/{RUN_A}/input_123456.pkl.gz")
    parsed = C.parse_artifacts(df, "p/").select("exp_id", "stage_dir", "task_index", "output_ts", "meta_id", "file")
    assert rows(parsed) == sorted([
        ("e", "outputs", None, "20260101-000000", "m1", "t.csv.gz"), ("e", None, None, None, None, "log"),
        (None, None, None, None, None, "readme"), ("e", None, 123456, None, None, "input_123456.pkl.gz")], key=repr)


def test_copy_skip_and_collision_partition_the_matches(spark, rows):
    plan = spark.createDataFrame([("e", f"e/{r}/f{i}", f"e/f{i}") for r in "abc" for i in range(5)],
                                 "exp_id STRING, path STRING, destination STRING")
    there = spark.createDataFrame([("e/f0",), ("e/f0",), ("e/z",)], "destination STRING")
    marked = C.split_existing(plan, there)
    assert rows(C.copy_counts(plan, there)) == [("e", 4, 1, 10)]
    assert rows(marked.groupBy("action").count()) == [("collision", 10), ("copy", 4), ("skip", 1)]
    assert rows(marked.where("action = 'copy'"), "path") == [(f"e/a/f{i}",) for i in range(1, 5)]


def test_plan_drops_hidden_experiments_and_takes_the_latest_run(spark, rows):
    df = paths(spark, f"hosp_e/{RUN_A}/x", f"hosp_e/{RUN_B}/x", f"hosp_e/sub/{RUN_B}/x", f"f/{RUN_A}/x")
    plan = C.retrieval_plan(df, "p/", ["hosp*", "f"])
    assert rows(plan, "exp_id", "run_id", "n_runs", F.size("targets")) == [("f", RUN_A, 1, 2), ("hosp_e", RUN_B, 2, 3)]
    assert rows(C.plan_totals(plan)) == [(2, 5)]


def test_yaml_beats_yml(spark, rows):
    df = spark.createDataFrame([("e", "a.yml"), ("e", "a.yaml"), ("e", "b.yml"), ("e", "c.txt")], "exp_id STRING, file STRING")
    assert rows(C.dedupe_by_stem(df), "file") == [("a.yaml",), ("b.yml",)]


# --- ordering ----------------------------------------------------------------------------------


def test_prefix_sum_equals_brute_force_with_a_hot_group(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(data, "g STRING, i INT, w BIGINT").repartition(7)
    got = {r.i: (r.position, r.before) for r in O.prefix_sum(
        O.prefix_sum(df, ["g"], ["i"]), ["g"], ["i"], weight="w", name="before").collect()}
    seen: dict = {}
    for g, i, w in data:
        n, total = seen.get(g, (0, 0))
        assert got[i] == (n, total)
        seen[g] = (n + 1, total + w)


def test_dense_index_is_dense(spark):
    df = spark.range(5000).withColumn("k", F.xxhash64("id")).repartition(6)
    got = O.dense_index(df, ["k"]).orderBy("k").select("task_index").collect()
    assert [r[0] for r in got] == list(range(5000))


def test_previous_row_crosses_partitions(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), rng.randint(0, 500), i if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(data, "k STRING, s BIGINT, v BIGINT").repartition(3)
    got = sorted(((r.k, r.s, r.v, r.prev_v) for r in O.previous_row(df, ["k"], ["s", "v"], ["v"]).collect()), key=repr)
    expected, last = [], {}
    for k, s, v in sorted(data, key=lambda r: (r[1], r[2] is not None, r[2] or 0)):
        expected.append((k, s, v, last.get(k)))
        last[k] = v
    assert got == sorted(expected, key=repr)


def test_one_series_in_one_instant_spans_many_tasks(spark, monkeypatch):
    kept = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay as they are
    monkeypatch.setattr(O, "materialize", lambda df: kept.append(materialize(df)) or kept[-1])
    df = spark.range(40_000).select(F.lit("a").alias("k"), F.lit(0).alias("s"), (F.col("id") % 2).alias("v")).repartition(5)
    got = O.previous_row(df, ["k"], ["s", "v"], ["v"])
    assert got.where("prev_v IS NULL").count() == 1 and got.where("v <> prev_v").count() == 1 and got.count() == 40_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in kept[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 20_000


def test_depth_counts_from_the_folder_of_the_pattern(spark):
    deep = "/".join(f"d{i}" for i in range(10))
    df = paths(spark, f"{deep}/{RUN_A}/f", f"{deep}/x/{RUN_B}/f", f"e/{RUN_A}/f")
    plan = lambda *patterns, depth=10: {r.exp_id for r in C.retrieval_plan(df, "p/", list(patterns), max_depth=depth).collect()}
    assert plan("*") == {"e"} and plan("d0/*") == {deep} and plan("d0/d1/*", "e") == {deep, "e"}
    assert plan("d0/*", depth=9) == set() and plan(deep, depth=1) == {deep}


# --- tasks -------------------------------------------------------------------------------------


@pytest.fixture
def gathered(spark):
    results = spark.createDataFrame([("r", 0, "ok"), ("r", 1, "failed"), ("r", 1, "ok"), ("r", 2, "failed"), ("r", 9, "ok"), ("s", 0, "failed")],
                                    "run_key STRING, task_index BIGINT, status STRING")
    runs = spark.createDataFrame([("r", 5), ("s", 1), ("t", 2)], "run_key STRING, n_expected INT")
    return results, runs


def test_gather_equals_counting(spark, rows):
    rng = random.Random(4)
    data = [(f"r{rng.randrange(6)}", rng.randrange(-70, 200), rng.choice(["ok", "failed", None])) for _ in range(900)]
    sizes = {"r0": 0, "r1": 1, "r2": 63, "r3": 64, "r4": 65, "r5": 150, "r6": 128}
    results = spark.createDataFrame(data, "run_key STRING, task_index INT, status STRING").repartition(4)
    runs = spark.createDataFrame(list(sizes.items()), "run_key STRING, n_expected INT")
    state = {}
    for k, i, s in data:
        if 0 <= i < sizes[k]:
            state[k, i] = "ok" if s == "ok" or state.get((k, i)) == "ok" else "failed"
    assert rows(T.task_status(results, runs)) == sorted(((*k, v) for k, v in state.items()), key=repr)
    gaps = [(k, i, state.get((k, i), "missing")) for k, n in sizes.items() for i in range(n) if state.get((k, i)) != "ok"]
    assert rows(T.gap_tasks(results, runs)) == sorted(gaps, key=repr)
    count = lambda k, s: sum(v == s for (a, _), v in state.items() if a == k)
    assert rows(T.gather(results, runs)) == [
        (k, n, count(k, "ok"), count(k, "failed"), n - count(k, "ok") - count(k, "failed")) for k, n in sorted(sizes.items())]


def test_gaps_scan_results_once(spark, tmp_path):
    spark.createDataFrame([("r", 0, "ok")], "run_key STRING, task_index INT, status STRING").write.parquet(str(tmp_path / "results"))
    runs = spark.createDataFrame([("r", 3)], "run_key STRING, n_expected INT")
    plan = T.gap_tasks(spark.read.parquet(str(tmp_path / "results")), runs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "hashpartitioning(run_key#" in plan and "word#" in plan


def test_gather_counts_and_gaps(gathered, rows):
    results, runs = gathered
    assert rows(T.gather(results, runs)) == [("r", 5, 2, 1, 2), ("s", 1, 0, 1, 0), ("t", 2, 0, 0, 2)]
    assert rows(T.gap_tasks(results, runs)) == [
        ("r", 2, "failed"), ("r", 3, "missing"), ("r", 4, "missing"), ("s", 0, "failed"), ("t", 0, "missing"), ("t", 1, "missing")]


def test_ok_failed_and_missing_partition_the_expected_tasks(spark):
    rng = random.Random(3)
    runs = spark.createDataFrame([(k, rng.randint(0, 30_000 if k == 0 else 20)) for k in range(20)], "run_key INT, n_expected INT")
    data = [(rng.randrange(20), rng.randrange(25), rng.choice(["ok", "failed"])) for _ in range(300)]
    results = spark.createDataFrame(data, "run_key INT, task_index BIGINT, status STRING")
    ok = T.task_status(results, runs).where("status = 'ok'").select("run_key", "task_index")
    parts = ok.unionByName(T.gap_tasks(results, runs).select("run_key", "task_index"))
    assert parts.exceptAll(T.expected_tasks(runs)).count() == 0
    assert T.expected_tasks(runs).exceptAll(parts).count() == 0


def test_policies(gathered):
    results, runs = gathered
    with pytest.raises(ValueError, match="2 run"):
        T.require_complete(results, runs, allow_partial=True)
    only = runs.where("run_key = 'r'")
    assert T.require_complete(results, only, allow_partial=True).count() == 2
    with pytest.raises(ValueError, match="incomplete"):
        T.require_complete(results, only, allow_partial=False)
    with pytest.raises(ValueError, match="no results"):
        T.require_complete(results, runs.where("run_key = 't'"))
    with pytest.raises(ValueError, match="no tasks"):
        T.require_tasks(results.limit(0))


def test_one_failing_task_does_not_stop_the_others(spark, rows):
    def model(workload):
        if workload["task_index"] == 2:
            raise RuntimeError("boom")
        return pd.DataFrame({"x": [float(workload["task_index"])] * 2, "label": ["a", "b"]})

    tasks = spark.range(4).withColumnRenamed("id", "task_index")
    got = rows(T.run_tasks(tasks, model, "x DOUBLE, label STRING", parallelism=2))
    assert len(got) == 7 and (2, "failed", "RuntimeError", "boom", None, None) in got
    assert (3, "ok", None, None, 3.0, "a") in got


def test_tasks_are_spread_whatever_their_files(spark):
    def model(workload):
        return pd.DataFrame({"x": [1.0]})

    tasks = spark.range(1500).coalesce(1).withColumnRenamed("id", "task_index")
    ran = T.run_tasks(tasks, model, "x DOUBLE").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(ran) == T.MAX_PARALLELISM and max(r["count"] for r in ran) < 60


def test_mixed_and_unknown_types(spark, rows):
    df = spark.createDataFrame([(1, "SimulationOutput"), (1, "CalibrationOutput"), (2, "CalibrationOutput"), (3, "Other")],
                               "run_key INT, type_name STRING")
    assert rows(T.result_type(df)) == [(1, "mixed"), (2, "calibration"), (3, "unknown")]
    with pytest.raises(ValueError):
        T.generate("unknown", {})


def test_lhs_uses_every_stratum_once_and_is_repeatable(spark):
    tasks = spark.range(200).withColumnRenamed("id", "k")
    design = T.task_lhs(tasks, "k", {"a": (0.0, 1.0), "b": (5.0, 9.0)}, seed=3).toPandas().sort_values("k")
    again = T.task_lhs(tasks.repartition(5), "k", {"a": (0.0, 1.0), "b": (5.0, 9.0)}, seed=3).toPandas().sort_values("k")
    assert sorted(design["a_stratum"]) == sorted(design["b_stratum"]) == list(range(200))
    assert list(design["b"]) == list(again["b"]) and design["b"].between(5, 9).all()
    assert list(design["a_stratum"]) != list(design["b_stratum"])


# --- results -----------------------------------------------------------------------------------


def test_quantiles_equal_numpy_for_small_and_hot_groups(spark):
    rng = np.random.default_rng(4)
    data = [("hot", float(v)) for v in np.round(rng.normal(size=900), 1)] + [("small", float(v)) for v in rng.normal(size=37)] + [("one", 2.5)]
    df = spark.createDataFrame(data + [("hot", None), ("none", None)], "g STRING, value DOUBLE")
    levels = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    got = {(r.g, r.level): r.value for r in R.quantiles(df, ["g"], levels).collect()}
    for group in ("hot", "small", "one"):
        expected = np.quantile([v for g, v in data if g == group], levels)
        assert [got[group, x] for x in levels] == pytest.approx(list(expected))
    assert len(got) == 18


def test_ranks_of_any_spread(spark):
    rng = random.Random(8)
    spreads = {
        "equal": [3.5] * 500, "signs": [rng.uniform(-1, 1) for _ in range(700)], "close": [1 + i * 2.0 ** -52 for i in range(300)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(300)], "one": [7.0],
        "tiny": [rng.randrange(-50, 50) * 5e-324 for _ in range(200)], "zeros": [0.0, -0.0] * 50 + [1.0],
        "clustered": [1.0 + rng.choice([0, 1e-9]) + rng.randrange(40) * 2.0 ** -50 for _ in range(900)],
    }
    data = [(k, v) for k, values in spreads.items() for v in values] + [("one", None), ("none", None)]
    df = spark.createDataFrame(data, "g STRING, value DOUBLE").repartition(5)
    levels = [0.0, 0.013, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.level): r.value for r in R.quantiles(df, ["g"], levels).collect()}
    assert len(got) == len(spreads) * len(levels)
    for g, values in spreads.items():
        values = sorted(v + 0.0 for v in values)
        for level in levels:
            spot = level * (len(values) - 1)
            low, share = int(np.floor(spot)), spot - np.floor(spot)
            expected = values[low] if share == 0 else (1 - share) * values[low] + share * values[low + 1]
            assert got[g, level] == expected, (g, level)
    ends = spark.createDataFrame([(1, v) for v in (float("nan"), float("-inf"), 2.0, float("inf"))], "g INT, value DOUBLE")
    low, two, high, nan = [r.value for r in R.quantiles(ends, ["g"], [0.0, 1 / 3, 2 / 3, 1.0]).orderBy("level").collect()]
    assert (low, two, high) == (float("-inf"), 2.0, float("inf")) and np.isnan(nan)


def test_quantile_of_sums_not_sum_of_quantiles(spark, rows):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 9.0), ("b", 1, 9.0), ("b", 2, 1.0)], "population STRING, traj_id INT, value DOUBLE")
    df = df.select("*", F.lit("2024-01-01").cast("date").alias("date"), F.lit("v").alias("variable"))
    assert rows(R.quantiles(R.aggregate_locations(df), levels=[0.0, 1.0]), "level", "value") == [(0.0, 10.0), (1.0, 10.0)]


# --- settings and documents --------------------------------------------------------------------


def merge(layers):
    """Brute force: dictionaries merged one after the other."""

    def deep(base, over):
        out = dict(base)
        for key, value in over.items():
            out[key] = deep(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
        return out

    merged = {}
    for layer in layers:
        merged = deep(merged, layer)
    return merged


def flat(tree, head=""):
    for key, value in tree.items():
        if isinstance(value, dict):
            yield from flat(value, f"{head}{key}.")
        else:
            yield f"{head}{key}", value


def test_layers_merge_like_nested_dictionaries(spark, rows):
    rng = random.Random(5)

    def tree(depth):
        return {k: tree(depth - 1) if depth and rng.random() < 0.6 else str(rng.randint(0, 99))
                for k in rng.sample("abc", rng.randint(1, 3))}

    expected, data = [], []
    for scope in range(60):
        layers = [tree(3) for _ in range(4)]
        data += [(scope, key, value, n) for n, layer in enumerate(layers) for key, value in flat(layer)]
        expected += [(scope, key, value) for key, value in flat(merge(layers))]
    df = spark.createDataFrame(data, "scope INT, key_path STRING, value STRING, layer INT")
    merged = G.merge_layers(df)
    assert rows(merged, "scope", "key_path", "value") == sorted(expected, key=repr)
    assert rows(G.merge_layers(merged)) == rows(merged)


def test_a_parent_of_very_many_keys_is_salted_by_their_number(spark, rows):
    data = [("s", f"a.k{i}", str(i), i % 2 * 2) for i in range(500)] + [("s", "a", "whole", 1), ("t", "a", "whole", 2), ("t", "a.b", "x", 1)]
    df = spark.createDataFrame(data, "scope STRING, key_path STRING, value STRING, layer INT")
    kept = rows(G.merge_layers(df, children_per_salt=7), "scope", "key_path", "value")
    # Layer 1 put a value in the subtree's place; layer 2 set keys below it again.
    assert kept == sorted([("s", f"a.k{i}", str(i)) for i in range(500) if i % 2] + [("t", "a", "whole")], key=repr)
    assert kept == rows(G.merge_layers(df), "scope", "key_path", "value")


def test_classes_of_sizes(spark):
    rng = random.Random(7)
    bounds = [(f"c{i}", round(rng.uniform(0, 50) ** 2, 2)) for i in range(30)]
    classes = [(c, low, None if i % 7 == 0 else low + rng.choice([0.0, 0.5, 3.0, 1e6])) for i, (c, low) in enumerate(bounds)]
    sizes = [round(rng.uniform(0, 55) ** 2, 2) for _ in range(300)] + [0.0, 1.0, 2.0, 1024.0] + [low for _, low in bounds]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(sizes)], "k INT, v DOUBLE")
    table = spark.createDataFrame(classes, "class STRING, low DOUBLE, high DOUBLE")
    got = sorted((r.k, r["class"]) for r in K.in_classes(df, "v", table).collect())
    assert got == sorted((i, c) for i, v in enumerate(sizes) for c, low, high in classes if low <= v and (high is None or v < high))


def test_usage_is_grouped_before_it_is_rolled_up(spark):
    df = spark.createDataFrame([("e", "r", 5)], "exp_id STRING, run_id STRING, length BIGINT")
    plan = C.storage_usage(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")


def test_required_fields(spark, rows):
    df = spark.createDataFrame([("s", "a", "x"), ("s", "b", "your-b"), ("s", "c", "")], "scope STRING, key_path STRING, value STRING")
    got = rows(G.required_fields(df, df.select("scope").distinct(), ["a", "b", "c", "d"]), "key_path", "ok")
    assert got == [("a", True), ("b", False), ("c", False), ("d", False)]


def docs(spark, *items):
    df = spark.createDataFrame([("e", f, d, ok) for f, d, ok in items], "exp_id STRING, file STRING, doc STRING, ok BOOLEAN")
    return G.with_type(df)


BASE, SAMPLING, OUT = '{"model": {}}', '{"modelset": {"sampling": {}}}', '{"output": null}'


def test_documents_by_type(spark, rows):
    typed = docs(spark, ("a.yaml", BASE, True), ("b.yaml", OUT, True), ("output.yml", OUT, True), ("c.yaml", "{oops", True), ("d.yaml", '{"outputs": 1}', True))
    assert rows(typed, "file", "type") == [("a.yaml", "basemodel"), ("b.yaml", "output"), ("c.yaml", None), ("d.yaml", None), ("output.yml", "output")]
    assert rows(G.resolve_docs(typed), "type", "file", "error") == [("basemodel", "a.yaml", None), ("output", "output.yml", None)]
    assert rows(G.resolve_output(typed, "a.yaml"), "file", "error") == [(None, "not an output document")]
    assert rows(G.resolve_output(typed, "zz"), "file", "error") == [(None, "not found")]


def test_factored_sets_equal_the_full_product(spark, rows):
    items = [(f"b{i}", BASE, i > 0) for i in range(3)] + [(f"m{i}", SAMPLING, True) for i in range(2)] + [(f"o{i}", OUT, i < 3) for i in range(4)]
    typed = docs(spark, *items)
    assert rows(G.set_counts(typed), "n_sets", "n_passed") == [(24, 12)]
    wanted = spark.createDataFrame([("e", i) for i in range(-1, 26)], "exp_id STRING, set_no BIGINT")
    picked = G.pick_sets(G.set_members(typed), wanted).toPandas()
    sets = {tuple(sorted(g["file"])) for _, g in picked.groupby("set_no")}
    assert sets == {(f"b{b}", f"m{m}", f"o{o}") for b in range(3) for m in range(2) for o in range(4)}
    assert rows(G.validation_summary(typed)) == [(1, 0, 1, 0)]
    assert rows(G.validation_summary(typed, "by_set")) == [(24, 12, 12, 0)]
    assert rows(G.validation_summary(typed.where("type <> 'basemodel'"))) == [(1, 0, 0, 1)]


def test_ambiguous_directory(spark, rows):
    dirs = spark.createDataFrame([("e1",), ("a/e1",), ("b/c/e2",), ("a/e3",)], "dir STRING")
    wanted = spark.createDataFrame([("e1",), ("x/e1",), ("e2",), ("e3",)], "exp_id STRING")
    assert rows(G.locate(wanted, dirs)) == [("e1", "e1", None), ("e2", None, "not found"), ("e3", "a/e3", None), ("x/e1", None, "ambiguous")]


# --- jobs, logs, metrics, cost -----------------------------------------------------------------


def test_progress_texts(spark, rows):
    counts = [(1, {"SUCCEEDED": "3", "FAILED": "1", "RUNNING": "2"}), (2, {"RUNNING": "0"}), (3, None), (4, {"succeeded": "5"})]
    df = spark.createDataFrame([(i, {"g": (c,)} if c is not None else None) for i, c in counts],
                               "i INT, task_groups MAP<STRING, STRUCT<counts: MAP<STRING, STRING>>>")
    assert rows(J.job_progress(J.unpack_counts(df)), "i", "tasks_active", "tasks_recent") == [
        (1, "4/6", "3/4"), (2, "pending", "N/A"), (3, "N/A", "N/A"), (4, "pending", "N/A")]


def test_limit_comes_after_the_filters(spark, rows):
    df = spark.createDataFrame([(f"n{i}", "ACTIVE", f"2024-01-{i:02d}T00:00:00Z", None, "flu/1" if i < 5 else "x") for i in range(1, 20)],
                               "name STRING, state STRING, start_time STRING, end_time STRING, argument STRING")
    assert rows(J.executions(df, exp="flu/1", limit=3), "name") == [("n2",), ("n3",), ("n4",)]


def test_log_terms_are_not_read_as_patterns(spark):
    df = spark.createDataFrame([({"job_uid": "stage-b-a50f0fb0-x"},), ({"job_uid": "stage.b"},)], "labels MAP<STRING, STRING>")
    assert L.filter_logs(df, job="stage.b").count() == 1
    assert L.filter_logs(df, execution="a50f0fb0-rest").count() == 1
    assert L.filter_logs(df).count() == 2


def test_console_and_json_lines(spark):
    lines = ["2031-02-03 04:05:06 builder WARNING [Task 12] wrote: x\ny", "2031-02-03 04:05:07 runner DEBUG idle", "no line of ours"]
    df = spark.createDataFrame([(x,) for x in lines], "line STRING").select(L.parse_console_line(F.col("line")).alias("p"))
    assert [tuple(r.p) for r in df.collect()] == [("2031-02-03 04:05:06", "builder", "WARNING", 12, "wrote: x\ny"),
                                                  ("2031-02-03 04:05:07", "runner", "DEBUG", None, "idle"), (None,) * 5]
    one = spark.range(1).select(L.parse_json_line(F.lit('{"stage": "runner", "task_index": 4, "extra": {"a": 1}}')).alias("p")).first().p
    assert (one.stage, one.task_index, one.extras) == ("runner", 4, {"extra": '{"a":1}'})


def test_rates_of_counters_with_a_reset(spark, rows):
    points = [(0, 10.0), (30, 16.0), (70, 4.0), (90, 10.0), (200, 70.0)]
    df = spark.createDataFrame([("m", "i", s, v) for s, v in points], "metric STRING, instance_name STRING, s BIGINT, value DOUBLE")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    rates = dict(rows(V.align_rate(df, 60, "cumulative"), F.unix_timestamp("window_start"), "value"))
    assert rates == {0: 0.1, 60: 10 / 60, 180: 1.0}
    means = V.align_mean(df, 60)
    assert means.count() == 3
    with pytest.raises(ValueError):
        V.align_rate(df, 60, "gauge")


def test_standard_tiles():
    tiles = V.standard_tiles()
    boards = pd.Series([t.dashboard for t in tiles]).value_counts().to_dict()
    assert boards == {"builder": 4, "runner": 5, "output": 4, "overall": 7} and len({t.title for t in tiles}) == 20


def test_unknown_machines_get_their_own_family(spark, rows):
    machines = K.machine_table(spark)
    asked = spark.createDataFrame([("c4d-standard-9",), ("c4-highcpu-2",), ("zz-1",), ("e2-standard-2",)], "machine_type STRING")
    assert rows(K.suggest(asked, machines), "machine_type", "suggestion") == [
        ("c4-highcpu-2", "c4-standard-2"), ("c4d-standard-9", "c4d-highmem-2"), ("c4d-standard-9", "c4d-standard-2")]
    wanted = asked.select("machine_type", F.lit(2000).alias("want_cpu_milli"), F.lit(8192).alias("want_memory_mib"))
    assert rows(K.fits(wanted, machines).where("fits is not null"), "machine_type", "fits") == [("e2-standard-2", True)]
