"""Result-table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanfold.operators import results as R
from fanfold.operators import tasks as K
from fanfold.plans.registry import Inputs, query

FIT_END = "2024-01-05"


def long_quantiles(source: str, keys: str, tail: str = "", levels=R.DEFAULT_LEVELS) -> str:
    """The check of a quantile table: one exact quantile per level, stacked."""
    shown = keys.replace("date", "cast(date AS string) AS date")
    parts = [f"SELECT {shown}, {level}::double AS level, round(quantile_cont(value, {level}), 6) AS value "
             f"FROM {source} {tail} GROUP BY {keys}" for level in levels]
    return " UNION ALL ".join(parts)


def trajectories(t: Inputs) -> DataFrame:
    return t.fx("fx_trajectories")


def rounded(df: DataFrame) -> DataFrame:
    """Values to six digits and dates as text, as the checks show them."""
    dates = [c for c in df.columns if c in ("date", "target_end_date")]
    return df.withColumns({"value": F.round("value", 6)} | {c: F.col(c).cast("string") for c in dates})


def nested(t: Inputs) -> DataFrame:
    """Trajectories as they arrive: one row each, an array of dated steps with a map of values.

    There is one step per day, so the length of an array follows the calendar.
    """
    step = F.struct("date", F.create_map("variable", "value").alias("values"))
    return trajectories(t).groupBy("population", "traj_id").agg(F.collect_list(step).alias("steps"))


@query("r1_trajectories", """
SELECT population, traj_id, cast(date AS string) AS date, variable, round(value, 6) AS value FROM fx_trajectories
""", "fx_trajectories")
def r1_trajectories(t: Inputs) -> DataFrame:
    return rounded(R.explode_trajectories(nested(t)))


@query("r2_quantiles", long_quantiles("fx_trajectories", "population, date, variable"), "fx_trajectories")
def r2_quantiles(t: Inputs) -> DataFrame:
    return rounded(R.quantiles(trajectories(t)))


# Fewer and larger groups.
@query("r2_ranked", long_quantiles("fx_trajectories", "population, variable"), "fx_trajectories")
def r2_ranked(t: Inputs) -> DataFrame:
    return rounded(R.quantiles(trajectories(t), ["population", "variable"]))


@query("r2_approx")
def r2_approx(t: Inputs) -> DataFrame:
    return R.quantiles(trajectories(t), exact=False)


@query("r2_bound", """
SELECT population, cast(date AS string) AS date, variable, level, true AS within
FROM (SELECT population, date, variable FROM fx_trajectories GROUP BY ALL), (SELECT unnest([0.025::double, 0.5, 0.975]) AS level)
""", "fx_trajectories")
def r2_bound(t: Inputs) -> DataFrame:
    """The rank of each sketched quantile is within the sketch's accuracy, and one row, of its level."""
    rows, sketch = trajectories(t), R.quantiles(trajectories(t), exact=False, accuracy=1000).withColumnRenamed("value", "q")
    ranks = rows.join(sketch, list(R.UNIT)).groupBy(*R.UNIT, "level").agg(
        F.count_if(F.col("value") < F.col("q")).alias("below"), F.count_if(F.col("value") <= F.col("q")).alias("upto"),
        F.count("value").alias("n"))
    wanted, slack = F.col("level") * F.col("n"), F.col("n") / 1000 + 1
    return ranks.select("population", F.col("date").cast("string").alias("date"), "variable", "level",
                        ((F.col("below") <= wanted + slack) & (F.col("upto") >= wanted - slack)).alias("within"))


@query("r3_national", "WITH total AS (SELECT traj_id, date, variable, sum(value) AS value FROM fx_trajectories "
       f"GROUP BY ALL) SELECT 'all' AS population, * FROM ({long_quantiles('total', 'date, variable')})",
       "fx_trajectories")
def r3_national(t: Inputs) -> DataFrame:
    return rounded(R.quantiles(R.aggregate_locations(trajectories(t))))


@query("r4_calibration", long_quantiles("fx_trajectories", "population, date, variable",
                                        f"WHERE date <= DATE '{FIT_END}'"), "fx_trajectories")
def r4_calibration(t: Inputs) -> DataFrame:
    return rounded(R.quantiles(R.calibration_window(trajectories(t), FIT_END)))


SCENARIO_SQL = """scenarios AS (
  SELECT 'base' AS scenario_id, * FROM fx_trajectories
  UNION ALL SELECT 'high', population, traj_id, date, variable, value * 2 FROM fx_trajectories)"""


def scenarios(t: Inputs) -> DataFrame:
    double = F.transform("steps", lambda s: F.struct(
        s["date"].alias("date"), F.transform_values(s["values"], lambda _, v: v * 2).alias("values")))
    both = F.map_from_arrays(F.array(F.lit("base"), F.lit("high")), F.array(F.col("steps"), double))
    return nested(t).select("population", "traj_id", both.alias("scenarios"))


@query("r4_projection", f"WITH {SCENARIO_SQL} " + long_quantiles(
    "scenarios", "scenario_id, population, date, variable", f"WHERE date > DATE '{FIT_END}'"), "fx_trajectories")
def r4_projection(t: Inputs) -> DataFrame:
    beyond = R.projection_window(R.explode_projections(scenarios(t)), FIT_END)
    return rounded(R.quantiles(beyond, ["scenario_id", *R.UNIT]))


@query("r5_projections", f"""
WITH {SCENARIO_SQL} SELECT scenario_id, population, traj_id, cast(date AS string) AS date, variable, round(value, 6) AS value FROM scenarios
""", "fx_trajectories")
def r5_projections(t: Inputs) -> DataFrame:
    return rounded(R.explode_projections(scenarios(t)))


def posterior_input(t: Inputs) -> DataFrame:
    """Per task two generations; the vector's halves are the two parameters."""
    n = F.floor(F.size("embedding") / 2).cast("int")

    def generation(number: int, factor: int):
        particle = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.create_map(
            F.lit("beta"), F.get("embedding", i) * factor, F.lit("gamma"), F.get("embedding", i + n) * factor))
        return F.struct(F.lit(number).alias("generation"), particle.alias("particles"))

    return t.embeddings.where(F.size("embedding") >= 2).select(F.col("vec_id").alias("task_index"),
                          F.array(generation(0, 1), generation(1, 2)).alias("generations"))


def posterior_sql(generations: str) -> str:
    return f"""
SELECT vec_id AS task_index, generation, i::integer AS particle_id, unnest(['beta', 'gamma']) AS parameter,
  unnest([round(embedding[i + 1]::double * (generation + 1), 5) + 0.0::double,
          round(embedding[i + 1 + len(embedding) // 2]::double * (generation + 1), 5) + 0.0::double]) AS value
FROM (SELECT *, unnest(range(len(embedding) // 2)) AS i FROM embeddings), (SELECT unnest({generations}) AS generation)"""


def five(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round(F.col("value").cast("double"), 5))


# As many particles as half a vector's elements. Adding 0.0 makes DuckDB's rounded -0.0 Spark's 0.0. Both names of each
# query read whole vectors.
@query("r6_whole", posterior_sql("[0, 1]"))
@query("r6_posteriors", posterior_sql("[0, 1]"))
def r6_posteriors(t: Inputs) -> DataFrame:
    return five(R.posteriors(posterior_input(t)))


@query("r6_whole_final", posterior_sql("[1]"))
@query("r6_final", posterior_sql("[1]"))
def r6_final(t: Inputs) -> DataFrame:
    return five(R.posteriors(posterior_input(t), last_only=True))


@query("r7_dates", """
SELECT c_custkey, cast(DATE '2024-10-01' + cast(round(c_acctbal / 100) AS integer) AS string) AS start_date FROM customer
""")
def r7_dates(t: Inputs) -> DataFrame:
    from fanfold.functions.scalars import offset_date

    return t.customer.select("c_custkey", offset_date(F.lit("2024-10-01").cast("date"), F.col("c_acctbal") / 100)
                             .cast("string").alias("start_date"))


PARTICLE_SQL = """
SELECT vec_id AS task_index, label AS generation, i::integer AS particle_id, round(abs(embedding[i + 1])::double, 5) AS distance,
  round(embedding[i + 1 + len(embedding) // 2]::double, 5) + 0.0::double AS weight
FROM (SELECT *, unnest(range(len(embedding) // 2)) AS i FROM embeddings)
"""


@query("r8_whole", PARTICLE_SQL)
@query("r8_particles", PARTICLE_SQL)
def r8_particles(t: Inputs) -> DataFrame:
    """As many particles as half a vector's elements: distances, then weights."""
    n = F.floor(F.size("embedding") / 2).cast("int")
    source = t.embeddings.select(F.col("vec_id").alias("task_index"), F.col("label").alias("generation"),
                                 F.transform(F.slice("embedding", 1, n), F.abs).alias("distances"),
                                 F.slice("embedding", n + 1, n).alias("weights"))
    return R.particles(source).withColumns({c: F.round(F.col(c).cast("double"), 5) for c in ("distance", "weight")})


@query("r9_metadata", """
SELECT run_key, task_index::bigint AS task_index, run_key * 100 + task_index AS seed, run_key / 8 AS beta, task_index / 4 AS gamma, status
FROM fx_results
""", "fx_results")
def r9_metadata(t: Inputs) -> DataFrame:
    results = t.fx("fx_results").select("run_key", "task_index", "status")
    params = F.create_map(F.lit("beta"), F.col("run_key") / 8, F.lit("gamma"), F.col("task_index") / 4)
    tasks = K.expected_tasks(t.fx("fx_runs")).select(
        "run_key", "task_index", (F.col("run_key") * 100 + F.col("task_index")).alias("seed"), params.alias("params"))
    return R.model_metadata(tasks, results, ["beta", "gamma"])


HUB_LEVELS = (0.0125, 0.0129, 0.5, 0.975)
HUB = {"population": "location", "date": "target_end_date", "level": "output_type_id", "value": "value"}


@query("r10_hub", "SELECT 'inc case' AS target, 'quantile' AS output_type, population AS location, "
       "date AS target_end_date, cast(level AS string) AS output_type_id, value FROM ("
       + long_quantiles("fx_trajectories", "population, date, variable", levels=HUB_LEVELS) + ")", "fx_trajectories")
def r10_hub(t: Inputs) -> DataFrame:
    return rounded(R.hub_format(R.quantiles(trajectories(t), levels=HUB_LEVELS), HUB, target="inc case", output_type="quantile"))


@query("r11_envelope", """
SELECT cast(date AS string) AS date, round(min(value), 6) AS low, round(max(value), 6) AS high FROM fx_trajectories GROUP BY date
""", "fx_trajectories")
def r11_envelope(t: Inputs) -> DataFrame:
    return R.envelope(trajectories(t)).select(F.col("date").cast("string").alias("date"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@K.output_table("simulation", "trajectories")
def trajectory_table(frames, options) -> DataFrame:
    return frames["trajectories"]


@K.output_table("simulation", "quantiles")
def quantile_table(frames, options) -> DataFrame:
    return R.quantiles(frames["trajectories"], levels=options.get("levels", R.DEFAULT_LEVELS))


@K.output_table("calibration", "calibration_quantiles")
def calibration_table(frames, options) -> DataFrame:
    return R.quantiles(R.calibration_window(frames["trajectories"], options["fit_end"]))


@K.output_table("calibration", "projection_quantiles")
def projection_table(frames, options) -> DataFrame:
    return R.quantiles(R.projection_window(frames["trajectories"], options["fit_end"]))


@query("t10_route", f"""
WITH q AS ({long_quantiles("fx_trajectories", "population, date, variable")}) SELECT tbl AS "table", count(*) AS n FROM (
  SELECT 'trajectories' AS tbl FROM fx_trajectories UNION ALL SELECT 'quantiles' FROM q
  UNION ALL SELECT CASE WHEN date <= '{FIT_END}' THEN 'calibration_quantiles' ELSE 'projection_quantiles' END FROM q)
GROUP BY tbl
""", "fx_trajectories")
def t10_route(t: Inputs) -> DataFrame:
    """Row counts of all tables that the two kinds of result are routed to."""
    frames, counts = {"trajectories": trajectories(t)}, None
    for kind in ("simulation", "calibration"):
        for name, df in K.generate(kind, frames, {"fit_end": FIT_END}).items():
            one = df.groupBy(F.lit(name).alias("table")).agg(F.count(F.lit(1)).alias("n"))
            counts = one if counts is None else counts.unionByName(one)
    return counts
