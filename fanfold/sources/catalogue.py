"""A stored catalogue of artifact paths, clustered so that a scan below some path starts opens few files.

:func:`write_catalogue` range-partitions the listing by path and sorts inside the files, so a file holds one stretch of paths, and
writes the smallest and largest path of each file beside the data. :func:`read_catalogue` picks the files that can hold a path
with one of the wanted starts, and states the starts as filters too, which Parquet skips row groups by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanfold.functions import paths as P

FILES = 200
BOUNDS = "file STRING, low STRING, high STRING"


def write_catalogue(listing: DataFrame, path: str, files: int = FILES) -> None:
    """Stores a listing in up to ``files`` files of neighbouring paths."""
    root = path.rstrip("/")
    listing.repartitionByRange(files, "path").sortWithinPartitions("path").write.parquet(f"{root}/data")
    stored = listing.sparkSession.read.parquet(f"{root}/data")
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    # Text longer than a bound would be cut by Parquet's own statistics; these are whole.
    stored.groupBy(name.alias("file")).agg(F.min("path").alias("low"), F.max("path").alias("high")).coalesce(1).write.parquet(f"{root}/bounds")


def files_below(spark: SparkSession, path: str, starts: Sequence[str]) -> list[str]:
    """Files that can hold a path with one of the starts."""
    bounds = spark.read.schema(BOUNDS).parquet(f"{path.rstrip('/')}/bounds")
    # A path from low to high can have a start iff low's beginning is not above it and high is not below it.
    meets = [(F.substring("low", 1, len(s)) <= s) & (F.col("high") >= s) for s in starts]
    return sorted(f"{path.rstrip('/')}/data/{r.file}" for r in bounds.where(P.any_of(meets)).select("file").collect())


def read_catalogue(spark: SparkSession, path: str, prefix: str = "", patterns: Sequence[str] = ("",)) -> DataFrame:
    """The rows whose path has ``prefix`` and then the literal start of any of the patterns; other files are not opened."""
    starts = [prefix + s for s in sorted({P.literal_part(p) for p in patterns})]
    schema = spark.read.parquet(f"{path.rstrip('/')}/data").schema
    found = files_below(spark, path, starts)
    rows = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    return rows.where(P.any_of(F.col("path").startswith(s) for s in starts))
