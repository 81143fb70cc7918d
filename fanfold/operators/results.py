"""Result tables: trajectories, quantiles, projections, posteriors and particles."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fanfold.operators.ordering import key_of
from fanfold.session import materialize

DEFAULT_LEVELS = (0.025, 0.5, 0.975)
UNIT = ("population", "date", "variable")
CELLS_PER_DOUBLING, CELLS = 1024, 4096


def explode_trajectories(nested: DataFrame) -> DataFrame:
    """``steps ARRAY<STRUCT<date, values MAP<variable, value>>>`` to one row per variable and date."""
    steps = nested.select("population", "traj_id", F.explode("steps").alias("step"))
    return steps.select("population", "traj_id", F.col("step.date").alias("date"),
                        F.explode("step.values").alias("variable", "value"))


def explode_projections(nested: DataFrame) -> DataFrame:
    """``scenarios MAP<scenario_id, steps>`` to long rows."""
    by_scenario = nested.select("population", "traj_id",
                                F.explode("scenarios").alias("scenario_id", "steps"))
    steps = by_scenario.select("scenario_id", "population", "traj_id", F.explode("steps").alias("step"))
    return steps.select("scenario_id", "population", "traj_id", F.col("step.date").alias("date"),
                        F.explode("step.values").alias("variable", "value"))


def quantiles(df: DataFrame, keys: Sequence[str] = UNIT, levels: Sequence[float] = DEFAULT_LEVELS,
              exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """One row per group and level; exact ones interpolate linearly between neighbours.

    ``percentile`` would keep the values of a group in one task. Here ranks are selected by refining histograms
    (:func:`select_ranks`), so neither a sort nor a copy of the values is needed and groups may have any size. Values are
    taken as doubles. ``exact=False`` uses a sketch of fixed size for every group.
    """
    keys = list(keys)
    if not exact:
        array = F.array(*[F.lit(float(v)) for v in levels])
        sketch = F.percentile_approx("value", array, F.lit(accuracy))
        return _to_levels(df.groupBy(*keys).agg(sketch.alias("__q")), keys, levels)

    def wanted(n: Column) -> Column:
        """The two neighbours of each level among ``n`` values."""
        spots = [F.lit(float(v)) * (n - 1) for v in levels]
        return F.array(*[F.struct(F.lit(float(v)).alias("level"), (spot - F.floor(spot)).alias("share"),
                                  F.lit(high).alias("high"), rank(spot).alias("rank"))
                         for v, spot in zip(levels, spots) for high, rank in ((False, F.floor), (True, F.ceil))])

    ends = select_ranks(df.select(key_of(keys).alias("__key"), F.col("value").cast("double").alias("value")), wanted)
    pair = ends.groupBy("__key", F.col("want.level").alias("level"), F.col("want.share").alias("__share")).agg(
        F.max(F.when(~F.col("want.high"), F.col("value"))).alias("__a"),
        F.max(F.when(F.col("want.high"), F.col("value"))).alias("__b"))
    value = F.when(F.col("__share") == 0, F.col("__a")).otherwise(
        (1 - F.col("__share")) * F.col("__a") + F.col("__share") * F.col("__b"))
    return pair.select(*[F.col("__key")[k].alias(k) for k in keys], "level", value.alias("value"))


def scale_cell(value: Column) -> Column:
    """A whole number that never falls as the value grows: cells of less than a thousandth of a value's size."""
    size = F.floor(CELLS_PER_DOUBLING * (F.log2(F.abs(value)) + 1075))
    top = F.lit(10**9)
    cell = F.when(F.isnan(value), top + 1).when(F.abs(value) == float("inf"), top).otherwise(size + 1)
    return F.when(value == 0, 0).when(value < 0, -cell).otherwise(cell).cast("long")


def select_ranks(rows: DataFrame, wanted: Callable[[Column], Column]) -> DataFrame:
    """The values at wanted ranks of each key, from ``(__key, value)``; NULL values are left out.

    ``wanted`` gives, from a key's number of values, an array of structs with a ``rank`` (from 0). The result has a row
    ``(__key, want, value)`` per element.

    Every round counts values per cell, with the smallest and largest of each: added up inside the tasks, so at most the
    cells leave a task, and the window over a key's cells is as long as there are cells. A rank at an end of its cell, or in a
    cell of one value, is found. For the others the next round reads their cells only, each cut into ``CELLS`` pieces
    between its ends. Values in a piece lie ``CELLS`` times closer than in the cell, so doubles are told apart after a few
    rounds.
    """
    rows = rows.where("value IS NOT NULL").withColumn("value", F.col("value") + F.lit(0.0))  # -0.0 is 0.0
    cells = rows.select("__key", "value", scale_cell(F.col("value")).alias("__cell"))
    found, origin, wants = None, None, None
    while True:
        counts = cells.groupBy("__key", "__cell").agg(
            F.count(F.lit(1)).alias("__n"), F.min("value").alias("__low"), F.max("value").alias("__high"))
        of_key = W.partitionBy("__key")
        earlier = of_key.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
        counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        if wants is None:
            all_wanted = counts.withColumns({"__wants": wanted(F.sum("__n").over(of_key)), "__origin": F.col("__key")})
        else:
            all_wanted = counts.join(wants, "__key")
        here = F.filter("__wants", lambda w: (w["rank"] >= F.col("__before")) & (w["rank"] < F.col("__before") + F.col("__n")))
        hits = all_wanted.withColumn("__wants", here).where(F.size("__wants") > 0)
        hits = materialize(hits.select("__origin", "__key", "__cell", "__n", "__before", "__low", "__high",
                                       F.explode("__wants").alias("__want")))
        inside = F.col("__want.rank") - F.col("__before")
        value = F.when(inside == 0, F.col("__low")).when((inside == F.col("__n") - 1) | (F.col("__low") == F.col("__high")),
                                                         F.col("__high"))
        done = hits.select(F.col("__origin").alias("__key"), F.col("__want").alias("want"), value.alias("value")).where("value IS NOT NULL")
        found = done if found is None else found.unionByName(done)
        # The rest, one row per cell; a cell is the key of the next round.
        rest = hits.where(value.isNull()).groupBy("__key", "__cell").agg(
            F.first("__origin").alias("__origin"), F.first("__low").alias("__low"), F.first("__high").alias("__high"),
            F.collect_list(F.col("__want").withField("rank", inside)).alias("__wants"))
        if rest.isEmpty():
            return found
        piece = F.least(F.lit(CELLS - 1), F.floor((F.col("value") - F.col("__low")) / (F.col("__high") - F.col("__low")) * CELLS))
        next_key = F.struct("__key", "__cell").alias("__key")
        cells = cells.join(rest.select("__key", "__cell", "__low", "__high"), ["__key", "__cell"]).select(
            next_key, "value", piece.cast("long").alias("__cell"))
        wants = rest.select(next_key, "__origin", "__wants")


def _to_levels(df: DataFrame, keys: Sequence[str], levels: Sequence[float]) -> DataFrame:
    named = F.arrays_zip(F.array(*[F.lit(float(v)) for v in levels]).alias("level"),
                         F.col("__q").alias("value"))
    return df.where("__q is not null").select(*keys, F.inline(named)).toDF(*keys, "level", "value")


def aggregate_locations(df: DataFrame, population: str = "all") -> DataFrame:
    """Sum over populations of each trajectory; quantiles are taken after it."""
    return (df.groupBy("traj_id", "date", "variable").agg(F.sum("value").alias("value"))
            .select(F.lit(population).alias("population"), "traj_id", "date", "variable", "value"))


def calibration_window(df: DataFrame, fit_end: str) -> DataFrame:
    return df.where(F.col("date") <= F.lit(fit_end).cast("date"))


def projection_window(df: DataFrame, fit_end: str) -> DataFrame:
    return df.where(F.col("date") > F.lit(fit_end).cast("date"))


def posteriors(nested: DataFrame, last_only: bool = False) -> DataFrame:
    """``generations ARRAY<STRUCT<generation, particles ARRAY<MAP<parameter, value>>>>`` per task to
    one row per generation, particle and parameter.

    The last generation is taken inside the task's own row, so no window is needed.
    """
    generations = F.col("generations")
    if last_only:
        final = F.array_max(F.transform(generations, lambda g: g["generation"]))
        generations = F.filter(generations, lambda g: g["generation"] == final)
    per_generation = nested.select("task_index", F.explode(generations).alias("g"))
    particles = per_generation.select("task_index", F.col("g.generation").alias("generation"),
                                      F.posexplode("g.particles").alias("particle_id", "params"))
    return particles.select("task_index", "generation", "particle_id",
                            F.explode("params").alias("parameter", "value"))


def particles(nested: DataFrame) -> DataFrame:
    """Arrays of distances and weights per generation to one row per particle."""
    zipped = F.arrays_zip("distances", "weights")
    rows = nested.select("task_index", "generation", F.posexplode(zipped).alias("particle_id", "p"))
    return rows.select("task_index", "generation", "particle_id", F.col("p.distances").alias("distance"),
                       F.col("p.weights").alias("weight"))


def model_metadata(tasks: DataFrame, results: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """Task settings with one column per parameter, joined to the results of the same task."""
    wide = tasks.select("run_key", "task_index", "seed",
                        *[F.try_element_at("params", F.lit(p)).alias(p) for p in parameters])
    return wide.join(results.select("run_key", "task_index", "status"), ["run_key", "task_index"])


def hub_format(quantile_rows: DataFrame, mapping: Mapping[str, str], **constants: str) -> DataFrame:
    """Renames columns by ``mapping`` (ours → theirs), adds constant columns, keeps nothing else.

    A level is written as the shortest decimal that reads back as the same number.
    """
    return quantile_rows.select(
        *[F.lit(v).alias(k) for k, v in constants.items()],
        *[(F.col("level").cast("string") if ours == "level" else F.col(ours)).alias(theirs)
          for ours, theirs in mapping.items()])


def envelope(df: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))
