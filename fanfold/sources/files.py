"""Artifact listings and table files; compression and format follow the file name."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTING = "path STRING, length BIGINT, modificationTime TIMESTAMP"
FORMATS = {"csv": ("csv", None), "csv.gz": ("csv", "gzip"), "json": ("json", None),
           "json.gz": ("json", "gzip"), "parquet": ("parquet", "zstd")}
STAMP = re.compile(r"\d{8}-\d{6}")


def list_artifacts(spark: SparkSession, prefix: str) -> DataFrame:
    """All files below ``prefix`` in path order; an absent prefix gives an empty frame.

    Only names, sizes and times are read, never the contents. Spark keeps the file list of a scan
    on the driver; for a store of many millions of objects read its inventory with
    :func:`read_manifest` instead.
    """
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(prefix))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LISTING)
    return files.select("path", "length", "modificationTime").orderBy("path")


def read_manifest(spark: SparkSession, path: str, prefixes: list[str] | None = None) -> DataFrame:
    """A stored listing (Parquet with ``path, length, modificationTime``), cut to the prefixes."""
    manifest = spark.read.schema(LISTING).parquet(path)
    if not prefixes:
        return manifest
    keep = F.lit(False)
    for prefix in prefixes:
        keep = keep | F.col("path").startswith(prefix)
    return manifest.where(keep)


def _reader(spark: SparkSession, schema: T.StructType | str | None) -> DataFrameReader:
    return spark.read.schema(schema) if schema else spark.read


def read_table(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table in one of :data:`FORMATS`; Spark unpacks ``.gz`` parts by their extension."""
    kind, _ = FORMATS[fmt]
    reader = _reader(spark, schema)
    return {"csv": lambda: reader.option("header", True).csv(path),
            "json": lambda: reader.json(path),
            "parquet": lambda: reader.parquet(path)}[kind]()


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document (object or array of objects) per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_table(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    kind, codec = FORMATS[fmt]
    writer = df.write.mode(mode).format(kind)
    writer = writer.option("header", True) if kind == "csv" else writer
    (writer.option("compression", codec) if codec else writer).save(path)


def output_dir(root: str, stamp: datetime | str, meta_id: str | None = None) -> str:
    """``root/outputs/YYYYMMDD-HHMMSS[_meta]``; the stamp is UTC and given by the caller."""
    text = stamp if isinstance(stamp, str) else stamp.strftime("%Y%m%d-%H%M%S")
    if not STAMP.fullmatch(text):
        raise ValueError(f"not a stamp: {text!r}")
    return f"{root.rstrip('/')}/outputs/{text}{f'_{meta_id}' if meta_id else ''}"


def write_outputs(spark: SparkSession, tables: Mapping[str, object], root: str, stamp: datetime | str,
                  meta_id: str | None = None, default_format: str = "csv.gz") -> DataFrame:
    """Writes every table below a fresh stamped directory and reports ``(table, format, saved)``.

    An entry is a frame or ``(frame, format)``; anything else (a figure, say) is reported as not
    saved. An existing directory is never written over.
    """
    target, report = output_dir(root, stamp, meta_id), []
    if not list_artifacts(spark, target).isEmpty():
        raise FileExistsError(f"already written: {target}")
    for name, entry in tables.items():
        df, fmt = entry if isinstance(entry, tuple) else (entry, default_format)
        saved = isinstance(df, DataFrame) and fmt in FORMATS
        if saved:
            write_table(df, f"{target}/{name}.{fmt}", fmt)
        report.append((name, str(fmt) if saved else None, saved))
    return spark.createDataFrame(report, "table STRING, format STRING, saved BOOLEAN")
