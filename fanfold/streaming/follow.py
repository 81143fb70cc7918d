"""Following logs and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fanfold.operators.logs import filter_logs
from fanfold.operators.metrics import BUCKET_SECONDS, SERIES, bucket
from fanfold.streaming.landing import land, landed


def once_each(logs: DataFrame) -> DataFrame:
    """One row per ``insert_id``: repeated deliveries go, rows that share a timestamp stay."""
    return logs.dropDuplicates(["insert_id"])


def follow_logs(stream: DataFrame, path: str, checkpoint: str, once: bool = False, **terms) -> StreamingQuery:
    """Lands the entries that pass :func:`filter_logs`; read them with :func:`followed_logs`."""
    return land(filter_logs(stream, **terms), path, checkpoint, once_each, once, merge=once_each)


def followed_logs(spark: SparkSession, path: str) -> DataFrame:
    """Every entry that has landed, once, however late it came."""
    return once_each(landed(spark, path))


def bucket_sums(df: DataFrame, seconds: int = BUCKET_SECONDS, series: Sequence[str] = SERIES) -> DataFrame:
    """Sum and number of values per series and bucket; these add up over batches."""
    sums = df.groupBy(bucket(seconds).alias("w"), *series).agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    return sums.select(F.col("w.start").alias("window_start"), *series, "total", "n")


def added(sums: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    return sums.groupBy("window_start", *series).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def follow_metrics(stream: DataFrame, path: str, checkpoint: str, seconds: int = BUCKET_SECONDS,
                   series: Sequence[str] = SERIES, once: bool = False) -> StreamingQuery:
    """Lands each batch's share of every bucket it touches; read the means with :func:`followed_metrics`."""
    return land(stream, path, checkpoint, lambda b: bucket_sums(b, seconds, series), once, merge=lambda sums: added(sums, series))


def followed_metrics(spark: SparkSession, path: str, series: Sequence[str] = SERIES) -> DataFrame:
    """The mean per series and bucket over all that has landed, as the batch operator gives it."""
    return added(landed(spark, path), series).select("window_start", *series, F.try_divide("total", "n").alias("value"))
