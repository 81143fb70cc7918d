"""Cost by label, machine look-ups and sizing classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fanfold.functions import scalars as S

# Published machine sizes with their hourly price.
MACHINES = [
    ("e2-standard-2", 2, 8192, 0.06701142),
    ("n2-standard-2", 2, 8192, 0.097118),
    ("c4-standard-2", 2, 8192, 0.096866),
    ("c4d-standard-2", 2, 7168, 0.089876046),
    ("c4d-highmem-2", 2, 15360, 0.11784067),
]
# Upper bound of the number of tasks, time limit in seconds, memory advice in GB.
GATHER_CLASSES = [(100, "small", 1800, "8"), (1000, "medium", 7200, "8-15"), (10000, "large", 14400, "16-32")]
# Upper bound of the expected hours of one task, time limit in seconds.
RUN_CLASSES = [(1, "short", 3600), (5, "medium", 18000), (10, "long", 36000)]
LONGEST_RUN = 604800


def machine_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MACHINES, "machine_type STRING, vcpus INT, memory_mib INT, usd_per_hour DOUBLE")


def cost(usage: DataFrame, prices: DataFrame, key: str = "machine_key") -> DataFrame:
    """Hours times price; usage without a price stays, with NULL cost. Spark broadcasts the prices
    when their measured size allows it and otherwise splits skewed keys."""
    return usage.join(prices, key, "left").withColumn("cost", F.col("hours") * F.col("usd_per_hour"))


def cost_by(df: DataFrame, labels: Sequence[str], amount: str = "cost",
            sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Totals of every combination of labels, or only of the listed ``sets`` of them; ``depth``
    counts the labels told apart in a row.

    A cube repeats its input 2^k times, so it runs over totals per full label set.
    """
    labels = list(labels)
    totals = df.groupBy(*labels).agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("n"))
    gid = F.grouping_id().alias("__gid")
    grouped = totals.groupingSets(sets, *labels) if sets is not None else totals.cube(*labels)
    cube = grouped.agg(F.sum("amount").alias(amount), F.sum("n").alias("n"), gid)
    depth = F.lit(len(labels)) - F.bit_count("__gid")
    return cube.select(*labels, depth.cast("int").alias("depth"), amount, "n")


def machine_specs(df: DataFrame, machines: DataFrame) -> DataFrame:
    """Adds milli-CPUs and memory of the machine type (NULL when unknown)."""
    specs = machines.select("machine_type", (F.col("vcpus") * 1000).alias("cpu_milli"), "memory_mib")
    return df.join(specs, "machine_type", "left")


def suggest(df: DataFrame, machines: DataFrame, k: int = 5) -> DataFrame:
    """For each unknown machine type up to ``k`` known ones of its family, in name order.

    The known list is cut to ``k`` per family before the join, so a large family never meets all
    requests of that family.
    """
    family = lambda: S.machine_parts(F.col("machine_type"))["family"].alias("family")
    known = machines.select("machine_type").distinct()
    unknown = df.select("machine_type").distinct().join(known, "machine_type", "left_anti")
    by_name = W.partitionBy("family").orderBy("machine_type")
    best = (known.select(family(), "machine_type").withColumn("rank", F.row_number().over(by_name))
            .where(F.col("rank") <= k)
            .select("family", F.col("machine_type").alias("suggestion"), "rank"))
    return unknown.select("machine_type", family()).join(best, "family").select(
        "machine_type", "suggestion", "rank")


def fits(df: DataFrame, machines: DataFrame) -> DataFrame:
    """Whether the requested CPU and memory fit the named machine; NULL for an unknown one."""
    specs = machine_specs(df, machines)
    ok = (F.col("want_cpu_milli") <= F.col("cpu_milli")) & (F.col("want_memory_mib") <= F.col("memory_mib"))
    return specs.withColumn("fits", ok)


def gather_class(n_tasks: Column) -> Column:
    """Size class, time limit and memory advice of the gathering step by number of tasks."""
    chain = F
    for bound, name, seconds, memory in GATHER_CLASSES:
        chain = chain.when(n_tasks < bound, F.struct(F.lit(name).alias("size_class"),
                                                     F.lit(seconds).alias("timeout"),
                                                     F.lit(memory).alias("memory_gb")))
    last = GATHER_CLASSES[-1]
    return chain.otherwise(F.struct(F.lit("very large").alias("size_class"), F.lit(last[2]).alias("timeout"),
                                    F.lit(last[3]).alias("memory_gb")))


def run_class(hours: Column) -> Column:
    """Size class and time limit of one task by its expected hours."""
    chain = F
    for bound, name, seconds in RUN_CLASSES:
        chain = chain.when(hours < bound, F.struct(F.lit(name).alias("size_class"), F.lit(seconds).alias("timeout")))
    return chain.otherwise(F.struct(F.lit("very long").alias("size_class"), F.lit(LONGEST_RUN).alias("timeout")))


BINS = 1024  # powers of two; a class without an upper bound reaches to the last


def _bin(value: Column) -> Column:
    """The number of the doubling a size lies in; 0 below 1."""
    return F.when(value < 1, 0).otherwise(F.least(F.lit(BINS), F.floor(F.log2(value)) + 1)).cast("int")


def in_classes(df: DataFrame, size: str, classes: DataFrame) -> DataFrame:
    """Every row with every class of a table ``(class, low, high)`` that its size lies in: ``low <= size < high``.

    A comparison alone would be a nested loop. Sizes (0 and above) and classes meet by the power of two they lie in or touch, an
    equi-join; the bounds are compared for the pairs found so. A NULL ``high`` has no end.
    """
    last = F.when(F.col("high").isNull(), BINS).otherwise(_bin(F.col("high").cast("double")))
    touched = classes.where("high IS NULL OR high > low").select("class", "low", "high", F.explode(
        F.sequence(_bin(F.greatest(F.col("low").cast("double"), F.lit(0.0))), last)).alias("__bin"))
    met = df.withColumn("__bin", _bin(F.col(size).cast("double"))).join(touched, "__bin")
    inside = (F.col(size) >= F.col("low")) & (F.col("high").isNull() | (F.col(size) < F.col("high")))
    return met.where(inside).select(*df.columns, "class")
