"""Per-stage telemetry summaries of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The statuses that mean success.
GOOD = ("success", "ok")
TELEMETRY_SCHEMA = "status STRING, duration DOUBLE, _bad STRING"
_FILE = r"(builder|runner|output)(?:_([0-9]+))?_summary\.json"


def read_telemetry(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """One row per summary below ``path``; stage and task come from the name and summaries that
    cannot be read are left out.

    With ``by_folder`` the name is that of the folder Spark wrote the summary into
    (``file=runner_00001_summary.json``).
    """
    reader = (spark.read.schema(TELEMETRY_SCHEMA).option("multiLine", True)
              .option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True))
    raw = reader.json(path) if by_folder else reader.option("pathGlobFilter", "*_summary.json").json(path)
    name = F.col("_metadata.file_path" if by_folder else "_metadata.file_name")
    rows = raw.select(F.regexp_extract(name, _FILE, 1).alias("stage"),
                      F.regexp_extract(name, _FILE, 2).try_cast("int").alias("task_index"),
                      "status", "duration", "_bad")
    return rows.where("stage <> '' and _bad is null").drop("_bad")


def workflow_summary(df: DataFrame, good: Sequence[str] = GOOD) -> DataFrame:
    """Counts and durations per stage and in total (``stage`` = ``total``); ``good`` statuses count as ok."""
    summary = df.rollup("stage").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(*good)).alias("n_ok"),
        F.sum("duration").alias("total_duration"), F.avg("duration").alias("mean_duration"),
        F.max("duration").alias("max_duration"), F.grouping("stage").alias("__total"))
    stage = F.when(F.col("__total") == 1, "total").otherwise(F.col("stage"))
    return summary.withColumn("stage", stage).drop("__total")


def summary_text(df: DataFrame) -> DataFrame:
    line = F.format_string("%s: %d of %d ok, %.1f s in total, longest %.1f s",
                           "stage", "n_ok", "n", "total_duration", "max_duration")
    return df.select("stage", line.alias("value"))


def write_summary(df: DataFrame, path: str, name: str) -> None:
    """The summary as JSON and as text next to it."""
    if "/" in name or "\\" in name:
        raise ValueError(f"summary name must not hold a path: {name!r}")
    df.write.mode("errorifexists").json(f"{path}/json/{name}")
    summary_text(df).select("value").write.mode("errorifexists").text(f"{path}/txt/{name}")
