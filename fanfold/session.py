"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


PARTITION_BYTES = 128 * 1024**2
ROWS_PER_TASK = 20_000
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WRITING = {  # Spark settings under which a step is written
    FREE_SHUFFLES: "true",
    # What goes to Python and back at once. Ten thousand texts, Spark's own bound, take tens of MB, several times over: as
    # Arrow vectors, as the stream of them, in the executor's heap, which keeps its size for all later steps, and in Python.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1024**2),
    # Rows that the Parquet reader holds as vectors; for 4096 texts, its own number, these are arrays of tens of MB a task.
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}


def shuffle_partitions(input_bytes: int) -> int:
    """Shuffle partitions of about 128 MB for an input of this size; AQE merges those left small."""
    return max(200, -(-input_bytes // PARTITION_BYTES))


def build_session(app: str = "fanfold", master: str | None = None, input_bytes: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew-join splitting; ``conf`` overrides any of it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
        **({"spark.sql.shuffle.partitions": str(shuffle_partitions(input_bytes))} if input_bytes else {}),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only on a single machine (a local master, as in tests) may it be absent; a fresh temporary
    folder is made then. A name without a scheme belongs to the default file system.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fanfold-"))
        current = context.getCheckpointDir()
    return os.path.dirname(current.rstrip("/"))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written copy.

    Needed where two branches must see the very same physical order (see
    :mod:`fanfold.operators.ordering`); the copy survives the loss of executors. Shuffle files behind it go as soon as it
    is written, so that a chain of steps holds those of one step at a time on disk, and Python functions get their rows in
    small batches, so that memory does not follow the length of the rows.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = {key: spark.conf.get(key, None) for key in WRITING}
    for key, value in WRITING.items():
        spark.conf.set(key, value)
    try:
        return df.select("*").checkpoint(eager=True)  # a plan made anew: the settings hold for plans made under them
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have about so many short rows, in no more tasks than they need; no fewer than there are cores."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))
