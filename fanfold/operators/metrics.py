"""Resource metrics aligned to fixed time buckets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fanfold.operators.ordering import previous_row

BUCKET_SECONDS = 60
SERIES = ("metric", "instance_name")


def bucket(seconds: int = BUCKET_SECONDS) -> Column:
    return F.window("ts", f"{seconds} seconds")


def align_mean(df: DataFrame, seconds: int = BUCKET_SECONDS, series: Sequence[str] = SERIES) -> DataFrame:
    """Mean per series and bucket; works on batch and streaming frames alike."""
    means = df.groupBy(bucket(seconds).alias("w"), *series).agg(F.avg("value").alias("value"))
    return means.select(F.col("w.start").alias("window_start"), *series, "value")


def counter_steps(df: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Replaces the reading of a running counter by its growth; a fall means it began again at 0."""
    steps = previous_row(df, series, ["ts", "value"], ["value"])
    growth = (F.when(F.col("prev_value").isNull(), 0.0)
              .when(F.col("value") < F.col("prev_value"), F.col("value"))
              .otherwise(F.col("value") - F.col("prev_value")))
    return steps.withColumn("value", growth).drop("prev_value")


def align_rate(df: DataFrame, seconds: int = BUCKET_SECONDS, kind: str = "delta",
               series: Sequence[str] = SERIES) -> DataFrame:
    """Per-second rate: of increments (``delta``) or of a running counter (``cumulative``)."""
    if kind not in ("delta", "cumulative"):
        raise ValueError(f"unknown counter kind: {kind!r}")
    points = counter_steps(df, series) if kind == "cumulative" else df
    sums = points.groupBy(bucket(seconds).alias("w"), *series).agg((F.sum("value") / seconds).alias("value"))
    return sums.select(F.col("w.start").alias("window_start"), *series, "value")


def ratio(df: DataFrame, numerator: str, denominator: str, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Mean of one metric over the mean of another, where an instance has both in a bucket.

    One conditional aggregate in place of joining two aligned frames: one scan, one shuffle.
    """
    mean = lambda name: F.avg(F.when(F.col("metric") == name, F.col("value")))
    both = (df.where(F.col("metric").isin(numerator, denominator))
            .groupBy(bucket(seconds).alias("w"), "instance_name")
            .agg(mean(numerator).alias("num"), mean(denominator).alias("den"))
            .where("num is not null and den is not null"))
    return both.select(F.col("w.start").alias("window_start"), "instance_name",
                       F.try_divide("num", "den").alias("value"))


def active_count(df: DataFrame, seconds: int = BUCKET_SECONDS, series: Sequence[str] = SERIES) -> DataFrame:
    """Number of series with a point in each bucket."""
    return align_mean(df, seconds, series).groupBy("window_start").agg(F.count(F.lit(1)).alias("active"))


def full_match(pattern: str) -> str:
    return rf"(?s)^(?:{pattern})\z"


def by_stage(df: DataFrame, *patterns: str) -> DataFrame:
    """Rows whose instance name matches one of the patterns as a whole."""
    return df.where(F.col("instance_name").rlike("|".join(map(full_match, patterns))))


# --- dashboards --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tile:
    dashboard: str
    title: str
    kind: str  # mean, rate, ratio or count
    metric: str
    pattern: str
    base: str | None = None  # denominator of a ratio

    def wants(self, metric: str) -> Column:
        return (F.col("metric") == metric) & F.col("instance_name").rlike(full_match(self.pattern))


# Metric names read by the dashboards.
METRICS = {"cpu": "instance/cpu/utilization", "cores": "instance/cpu/usage_time",
           "used": "instance/memory/balloon/ram_used", "size": "instance/memory/balloon/ram_size"}
STAGE_SUFFIX = {"Builder": "stage-a", "Runner": "stage-b.*", "Output": "stage-c.*"}


def standard_tiles(metrics: dict[str, str] = METRICS, prefix: str = "run") -> list[Tile]:
    """The twenty tiles: four per stage, one more for the runner, and seven over all stages."""
    stage = {name: f"{prefix}-.*-{suffix}" for name, suffix in STAGE_SUFFIX.items()}
    tiles = []
    for name, pattern in stage.items():
        board = name.lower()
        tiles += [
            Tile(board, f"{name} CPU Utilization (%)", "mean", metrics["cpu"], pattern),
            Tile(board, f"{name} Memory Usage (%)", "ratio", metrics["used"], pattern, metrics["size"]),
            Tile(board, f"{name} Memory Usage (MiB)", "mean", metrics["used"], pattern),
            Tile(board, f"{name} CPU Core Usage (vCPU)", "rate", metrics["cores"], pattern),
        ]
    tiles.append(Tile("runner", "Runner Parallelism (Active Instances)", "count", metrics["cpu"],
                      stage["Runner"]))
    for unit, metric in (("CPU Utilization (%)", "cpu"), ("Memory Usage (MiB)", "used")):
        tiles += [Tile("overall", f"Stage {letter} ({name}) - {unit}", "mean", metrics[metric], pattern)
                  for letter, (name, pattern) in zip("ABC", stage.items())]
    tiles.append(Tile("overall", "Active Instances (All Stages)", "count", metrics["cpu"],
                      "|".join(f"(?:{p})" for p in stage.values())))
    return tiles


def dashboard(df: DataFrame, tiles: Sequence[Tile], seconds: int = BUCKET_SECONDS,
              counters: Sequence[str] = ()) -> DataFrame:
    """All tiles as one tidy frame ``(dashboard, tile, window_start, series, value)``.

    The points are aligned once; the tiles fan out from the aligned rows. ``counters`` names the
    metrics that are running counters.
    """
    wanted = {t.metric for t in tiles} | {t.base for t in tiles if t.base}
    points = df.where(F.col("metric").isin(sorted(wanted)))
    if counters:
        running = F.col("metric").isin(list(counters))
        points = counter_steps(points.where(running)).unionByName(points.where(~running))
    aligned = points.groupBy(bucket(seconds).alias("w"), *SERIES).agg(
        F.avg("value").alias("mean"), F.sum("value").alias("sum"))

    uses = []
    for tile in tiles:
        head = dict(dashboard=tile.dashboard, tile=tile.title, kind=tile.kind)
        for metric, role in ((tile.metric, "value"), (tile.base, "base")):
            if metric:
                entry = F.struct(*[F.lit(v).alias(k) for k, v in head.items()], F.lit(role).alias("role"))
                uses.append(F.when(tile.wants(metric), entry))
    fan = aligned.select(F.col("w.start").alias("window_start"), "instance_name", "mean", "sum",
                         F.explode(F.array_compact(F.array(*uses))).alias("t"))
    rows = fan.select("t.*", "window_start", "mean", "sum",
                      F.when(F.col("t.kind") == "count", "all").otherwise(F.col("instance_name")).alias("series"))
    part = lambda role: F.max(F.when(F.col("role") == role, F.col("mean")))
    cells = rows.groupBy("dashboard", "tile", "kind", "window_start", "series").agg(
        part("value").alias("value"), part("base").alias("base"),
        F.max("sum").alias("sum"), F.count(F.lit(1)).alias("n"))
    value = (F.when(F.col("kind") == "mean", F.col("value"))
             .when(F.col("kind") == "rate", F.col("sum") / seconds)
             .when(F.col("kind") == "count", F.col("n").cast("double"))
             .otherwise(F.try_divide("value", "base")))
    return cells.select("dashboard", "tile", "window_start", "series", value.alias("value")).where(
        "value is not null")


# --- alerts ------------------------------------------------------------------------------------


def failure_alerts(jobs: DataFrame, limit: float = 0.1) -> DataFrame:
    """Jobs whose share of failed tasks is above the limit."""
    total = F.col("succeeded") + F.col("failed") + F.col("running") + F.col("pending")
    share = F.try_divide("failed", total)
    return jobs.select("job_id", "failed", total.alias("total"), share.alias("failure_rate")).where(
        F.col("failure_rate") > limit)


def budget_crossings(cost: DataFrame, budget: float, levels: Sequence[float] = (0.5, 0.8, 1.0)) -> DataFrame:
    """First day of each month on which spending has reached each share of the budget.

    Costs are summed per day first, so the running sum sees at most 31 rows per month.
    """
    daily = cost.groupBy("day").agg(F.sum("cost").alias("cost"))
    month = F.date_format("day", "yyyy-MM")
    so_far = W.partitionBy("month").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    spent = daily.withColumn("month", month).withColumn("spent", F.sum("cost").over(so_far))
    reached = spent.select("month", "day", "spent", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    return reached.where(F.col("spent") >= F.col("level") * budget).groupBy("month", "level").agg(
        F.min("day").alias("day"))
