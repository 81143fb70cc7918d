"""Listing a store of any size in tasks: no list of files ever lies on the driver.

:func:`walk_store` goes breadth first. The folders of a level are dealt to tasks, each task lists its folders with
``pyarrow.fs``, and the folders found are the next level, until there are none. Every level is written to the shared
folder, so a lost executor repeats part of one level. A task holds the entries of one folder at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanfold.session import materialize
from fanfold.sources.files import LISTING

FOLDERS_PER_TASK = 64
_ENTRIES = "path STRING, folder BOOLEAN, length BIGINT, modificationTime TIMESTAMP"


def _base(root: str) -> str:
    """What stands before a path of the file system to make it a path of Spark's."""
    parts = urlsplit(root)
    if parts.scheme in ("", "file"):
        return "file:"
    return f"{parts.scheme}://{parts.netloc}" if parts.scheme in ("hdfs", "viewfs") else f"{parts.scheme}://"


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _list_folders(batches: Iterator[pa.RecordBatch], root: str, base: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system = fs.LocalFileSystem() if base == "file:" else fs.FileSystem.from_uri(root)[0]

    schema = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC"))])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            inside = fs.FileSelector(path.removeprefix(base), allow_not_found=True)
            found = [f for f in system.get_file_info(inside) if not _hidden(f.base_name)]
            kinds = [f.type == fs.FileType.Directory for f in found]
            yield pa.RecordBatch.from_arrays([
                pa.array([base + f.path for f in found], pa.string()), pa.array(kinds, pa.bool_()),
                pa.array([None if d else f.size for f, d in zip(found, kinds)], pa.int64()),
                pa.array([None if d else f.mtime for f, d in zip(found, kinds)], pa.timestamp("us", "UTC"))], schema=schema)


def walk_store(spark: SparkSession, root: str, folders_per_task: int = FOLDERS_PER_TASK) -> DataFrame:
    """All files below ``root`` as :func:`fanfold.sources.files.list_artifacts` gives them, in no order; an absent root
    gives an empty frame. ``root`` must be known to ``pyarrow.fs`` on the executors (local, HDFS, S3, GCS)."""
    base = _base(root)
    first = root if base != "file:" else f"file:{urlsplit(root).path}"
    level, files, n = spark.createDataFrame([(first.rstrip("/"),)], "path STRING"), spark.createDataFrame([], LISTING), 1
    while n:
        dealt = level.repartition(max(1, -(-n // folders_per_task)))
        found = materialize(dealt.mapInArrow(lambda batches: _list_folders(batches, root, base), _ENTRIES))
        # Milliseconds, as Hadoop keeps them.
        whole = F.date_trunc("millisecond", "modificationTime")
        files = files.unionByName(found.where("NOT folder").drop("folder").withColumn("modificationTime", whole))
        level = found.where("folder").select("path")
        n = level.count()
    return files
