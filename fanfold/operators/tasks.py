"""Task sets, running a user function over them, and gathering what came back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanfold.functions import paths as P
from fanfold.operators.ordering import dense_index, prefix_sum
from fanfold.session import materialize

SEQUENCE_BLOCK = 10_000
WORD = 64
MAX_PARALLELISM = 100
RESULT_ROWS = 10_000


def task_grid(base: DataFrame, **values: Sequence) -> DataFrame:
    """Every row of ``base`` with every combination of the listed parameter values.

    The value lists are arguments, so the product is an ``explode`` of literals inside the scan of
    ``base``: no join and no shuffle.
    """
    grid = base
    for name, choices in values.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, choices))))
    return grid


def task_lhs(tasks: DataFrame, key: str, ranges: Mapping[str, tuple[float, float]], seed: int) -> DataFrame:
    """Latin-hypercube design: one point per task, each of the N strata of a range used once.

    Strata are ranks of a hash of (seed, dimension, key) and the point is the middle of its
    stratum, so the same input always gives the same design. ``key`` must be unique.

    All dimensions are ranked in one sort: the key is listed once per dimension, and a dimension is a group.
    """
    if not ranges:
        return tasks
    listed = tasks.select(F.col(key).alias("__lhs_key"), F.explode(F.array(*map(F.lit, ranges))).alias("__lhs_name"))
    shuffled = F.md5(F.concat_ws("/", F.lit(str(seed)), "__lhs_name", F.col("__lhs_key").cast("string")).cast("binary"))
    ranked = prefix_sum(listed, ["__lhs_name"], [shuffled, F.col("__lhs_key")], name="__lhs_stratum")
    of = lambda name: F.max(F.when(F.col("__lhs_name") == name, F.col("__lhs_stratum")))
    strata = ranked.groupBy("__lhs_key").agg(*[of(name).alias(f"{name}_stratum") for name in ranges])
    # The number of keys is one more than the highest rank; one row.
    n = strata.agg(F.max(f"{next(iter(ranges))}_stratum")).first()[0]
    design = tasks.join(strata, tasks[key].eqNullSafe(strata["__lhs_key"])).drop("__lhs_key")
    for name, (low, high) in ranges.items():
        share = (F.col(f"{name}_stratum") + F.lit(0.5)) / F.lit((n or 0) + 1)
        design = design.withColumn(name, F.lit(low) + share * (high - low))
    return design


def index_tasks(df: DataFrame, order_by: Sequence[str | Column], kind: str = "input") -> DataFrame:
    """Dense task index from 0 and the name of the task's file."""
    return dense_index(df, order_by).withColumn("task_file", P.task_file(kind, F.col("task_index")))


def task_budget(tasks: DataFrame, keys: Sequence[str] = ("run_key",), max_parallelism: int = MAX_PARALLELISM) -> DataFrame:
    """Number of tasks, parallel slots and waves of each run."""
    slots = F.least(F.col("n_tasks"), F.lit(max_parallelism))
    return (tasks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tasks"))
            .withColumn("parallelism", slots)
            .withColumn("waves", F.ceil(F.col("n_tasks") / F.col("parallelism"))))


def require_tasks(tasks: DataFrame) -> DataFrame:
    if tasks.isEmpty():
        raise ValueError("no tasks: the task set is empty")
    return tasks


# --- run ---------------------------------------------------------------------------------------


def run_tasks(tasks: DataFrame, fn: Callable[[dict], pd.DataFrame], schema: T.StructType | str,
              parallelism: int | None = None, max_parallelism: int = MAX_PARALLELISM) -> DataFrame:
    """Calls ``fn(workload)`` once per task row and keeps going when one fails.

    ``tasks`` has one row per task with ``task_index``. The result holds the columns of ``schema``
    plus ``task_index, status, error_type, error_message``; a failed task gives one row with NULL
    results. Tasks are rows, not groups, so no task needs more memory than its own workload.

    Tasks are dealt evenly to ``parallelism`` partitions; without it to as many as there are tasks,
    ``max_parallelism`` at most, whatever files the task table lies in.
    """
    result = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    extra = T.StructType.fromDDL("task_index BIGINT, status STRING, error_type STRING, error_message STRING")
    names, full = result.names, T.StructType([*extra.fields, *result.fields])

    def plain(frame: pd.DataFrame) -> pd.DataFrame:
        """Columns without any value as objects: NaN does not turn into text or dates."""
        empty = [name for name in frame if frame[name].isna().all()]
        return frame.assign(**{name: pd.Series([None] * len(frame), frame.index, object) for name in empty})[full.names]

    def flush(good: list[pd.DataFrame], bad: list[tuple]) -> Iterator[pd.DataFrame]:
        if good:
            yield plain(pd.concat(good).assign(status="ok", error_type=None, error_message=None))
        if bad:
            yield plain(pd.DataFrame(bad, columns=extra.names).reindex(columns=full.names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        good, bad, held = [], [], 0
        for batch in batches:
            for workload in batch.to_dict("records"):
                index = workload["task_index"]
                try:
                    out = fn(workload).reindex(columns=names).assign(task_index=index)
                    good.append(out)
                    held += len(out)
                except Exception as error:  # noqa: BLE001 - every failure becomes a row
                    bad.append((index, "failed", type(error).__name__, str(error)))
                    held += 1
                if held >= RESULT_ROWS:
                    yield from flush(good, bad)
                    good, bad, held = [], [], 0
        yield from flush(good, bad)

    slots = parallelism or max(1, min(tasks.count(), max_parallelism))
    # Rows are dealt in turn: as even as ranges of the index, without sampling the tasks first.
    return tasks.repartition(slots).mapInPandas(run, full)


# --- gather ------------------------------------------------------------------------------------


def arrived_words(results: DataFrame) -> DataFrame:
    """Arrived and good task numbers as bits: one row ``(run_key, word, seen, good)`` per 64 numbers of a run.

    The words are put together inside the tasks by ``bit_or``, so a run of n results leaves a task as n / 64 rows at most.
    Words of 64 bits keep small runs small, where a bitmap of fixed size would take kilobytes for a few tasks.
    """
    index = F.col("task_index").cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), index.bitwiseAND(F.lit(WORD - 1)).cast("int"))
    ok = F.when(F.col("status") == "ok", bit).otherwise(F.lit(0).cast("bigint"))
    return results.where("task_index >= 0").groupBy("run_key", F.shiftright(index, 6).alias("word")).agg(
        F.bit_or(bit).alias("seen"), F.bit_or(ok).alias("good"))


def _inside(words: DataFrame) -> DataFrame:
    """Words with ``n_expected`` as bits ``ok``, ``failed`` and ``missing`` of the ``n_bits`` expected tasks in each."""
    n_bits = F.least(F.col("n_expected").cast("bigint") - F.col("word") * WORD, F.lit(WORD).cast("bigint")).cast("int")
    ones = F.lit(-1).cast("bigint")
    expected = F.when(F.col("n_bits") == WORD, ones).otherwise(
        F.bitwise_not(F.call_function("shiftleft", ones, F.col("n_bits"))))
    e, seen, good = F.col("expected"), F.col("seen"), F.col("good")
    return words.withColumn("n_bits", n_bits).where("n_bits > 0").withColumn("expected", expected).select(
        "run_key", "word", "n_bits", good.bitwiseAND(e).alias("ok"),
        seen.bitwiseAND(F.bitwise_not(good)).bitwiseAND(e).alias("failed"), F.bitwise_not(seen).bitwiseAND(e).alias("missing"))


def _of_runs(words: DataFrame, runs: DataFrame) -> DataFrame:
    return _inside(words.join(runs.select("run_key", "n_expected"), "run_key"))


def _statuses(words: DataFrame, *kinds: str) -> DataFrame:
    """One row per set bit of the named columns."""

    def listed(kind: str) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.col("n_bits") - 1),
                          lambda i: F.call_function("shiftright", F.col(kind), i).bitwiseAND(F.lit(1).cast("bigint")) == 1)
        return F.transform(places, lambda i: F.struct((F.col("word") * WORD + i).alias("task_index"), F.lit(kind).alias("status")))

    some = " OR ".join(f"{k} <> 0" for k in kinds)
    return words.where(some).select("run_key", F.inline(F.concat(*map(listed, kinds))))


def task_status(results: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per result inside ``0 … n_expected-1``; a task with any good copy is ok."""
    return _statuses(_of_runs(arrived_words(results), runs), "ok", "failed")


def gather(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Expected, ok, failed and missing tasks of every run, runs without any result included."""
    return _gathered(arrived_words(results), runs)


def _gathered(words: DataFrame, runs: DataFrame) -> DataFrame:
    seen = _of_runs(words, runs).groupBy("run_key").agg(
        F.sum(F.bit_count("ok")).alias("n_ok"), F.sum(F.bit_count("failed")).alias("n_failed"))
    counts = runs.select("run_key", "n_expected").join(seen, "run_key", "left").na.fill(0, ["n_ok", "n_failed"])
    return counts.withColumn("n_missing", F.col("n_expected") - F.col("n_ok") - F.col("n_failed"))


def expected_tasks(runs: DataFrame) -> DataFrame:
    """One row per task of each run, made block by block so no array grows with a run."""
    blocks = runs.where("n_expected > 0").select("run_key", "n_expected", F.explode(
        F.sequence(F.lit(0), F.col("n_expected").cast("bigint") - 1, F.lit(SEQUENCE_BLOCK))).alias("__from"))
    last = F.least(F.col("__from") + SEQUENCE_BLOCK, F.col("n_expected").cast("bigint")) - 1
    return blocks.select("run_key", F.explode(F.sequence("__from", last)).alias("task_index"))


def expected_words(runs: DataFrame) -> DataFrame:
    """One row ``(run_key, n_expected, word)`` per 64 expected tasks, made block by block as :func:`expected_tasks`."""
    blocks = runs.where("n_expected > 0").select("run_key", "n_expected", F.shiftright(F.col("n_expected").cast("bigint") - 1, 6).alias("__last"))
    blocks = blocks.select("run_key", "n_expected", "__last", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("__last"), F.lit(SEQUENCE_BLOCK).cast("bigint"))).alias("__from"))
    last = F.least(F.col("__from") + (SEQUENCE_BLOCK - 1), F.col("__last"))
    return blocks.select("run_key", "n_expected", F.explode(F.sequence("__from", last)).alias("word"))


def gap_tasks(results: DataFrame, runs: DataFrame) -> DataFrame:
    """The failed and the missing tasks as rows (never as a list inside one row); the results are read once."""
    words = expected_words(runs).join(arrived_words(results), ["run_key", "word"], "left").na.fill(0, ["seen", "good"])
    return _statuses(_inside(words), "failed", "missing")


def completeness(results: DataFrame, runs: DataFrame) -> DataFrame:
    counts = gather(results, runs)
    return counts.select("run_key", F.concat_ws("/", "n_ok", "n_expected").alias("completeness"),
                         F.try_divide(F.col("n_ok"), F.col("n_expected")).alias("ratio"))


def policy(counts: DataFrame, allow_partial: bool = True) -> DataFrame:
    """Verdict per run: ``ok``, ``partial``, ``incomplete`` (strict) or ``empty``."""
    gap = F.col("n_failed") + F.col("n_missing") > 0
    verdict = (F.when(F.col("n_ok") == 0, "empty")
               .when(gap, "partial" if allow_partial else "incomplete").otherwise("ok"))
    return counts.withColumn("verdict", verdict)


def require_complete(results: DataFrame, runs: DataFrame, allow_partial: bool = True) -> DataFrame:
    """The ok tasks, after a check that raises when the policy is broken.

    Only one summary row reaches the driver. The results are read once; their bits are written for both uses.
    """
    words = materialize(arrived_words(results))
    broken = policy(_gathered(words, runs), allow_partial).agg(
        F.count_if(F.col("verdict") == "empty").alias("empty"),
        F.count_if(F.col("verdict") == "incomplete").alias("incomplete"),
        F.sum("n_ok").alias("ok"), F.sum("n_expected").alias("n")).first()
    if not broken["ok"]:
        raise ValueError("no results: every task failed or is missing")
    if broken["empty"] or broken["incomplete"]:
        raise ValueError(f"{broken['empty']} run(s) without results, {broken['incomplete']} incomplete; "
                         f"{broken['ok']}/{broken['n']} tasks ok")
    return _statuses(_of_runs(words, runs), "ok")


def result_type(results: DataFrame, column: str = "type_name") -> DataFrame:
    """Kind of result per run from the type's name; ``mixed`` and ``unknown`` are errors to act on."""
    name = F.col(column)
    kind = (F.when(name.contains("Simulation"), "simulation")
            .when(name.contains("Calibration"), "calibration").otherwise("unknown"))
    kinds = results.groupBy("run_key").agg(F.min(kind).alias("low"), F.max(kind).alias("high"))
    single = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("mixed")
    return kinds.select("run_key", single.alias("result_type"))


# --- output routing ----------------------------------------------------------------------------

TableBuilder = Callable[[Mapping[str, DataFrame], Mapping], DataFrame]
_BUILDERS: dict[str, dict[str, TableBuilder]] = {}


def output_table(kind: str, name: str) -> Callable[[TableBuilder], TableBuilder]:
    """Registers a function from input frames and options to one output table."""

    def keep(builder: TableBuilder) -> TableBuilder:
        _BUILDERS.setdefault(kind, {})[name] = builder
        return builder

    return keep


def generate(kind: str, frames: Mapping[str, DataFrame], options: Mapping | None = None) -> dict[str, DataFrame]:
    """All tables registered for a kind of result, as lazy frames."""
    if kind not in _BUILDERS:
        raise ValueError(f"no output tables for result type {kind!r}")
    return {name: build(frames, options or {}) for name, build in _BUILDERS[kind].items()}
