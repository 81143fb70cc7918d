"""What the operators of this subpackage share: reading rows, words, Arrow batches and kept rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fanfold.session import materialize

# The separators of words, as bytes.split() has them: \x20 and \x09-\x0D.
WORD_GAPS = " \t\n\x0b\x0c\r"
BROADCAST_ROWS = 500_000  # keys of dropped rows, about fifty bytes each


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that no other column's name can clash with its own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to be new to ``df``; Spark ignores case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def in_remainder(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8, NULL as empty; Arrow hands its bytes over without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def give_back() -> None:
    """Hands memory that a Python worker has freed back to the system, where the C library can: the worker outlives its task, and
    what it keeps would count beside the executor's heap in every later step."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def per_batch(df: DataFrame, schema: str | T.StructType,
              start: Callable[[], Callable[[pa.RecordBatch], Sequence]]) -> DataFrame:
    """Runs ``start()`` once per task and the function it returns on every Arrow batch.

    The function gives one sequence (or Arrow array) per column of ``schema``. Spark bounds a batch by bytes.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            columns = work(batch)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)],
                schema=arrow)
        give_back()

    return df.mapInArrow(run, kind)


def bounded_cache(limit: int, compute: Callable):
    """A dict that fills itself by ``compute`` and is emptied when it holds ``limit`` entries."""

    class Cache(dict):
        def __missing__(self, key):
            if len(self) >= limit:
                self.clear()
            value = self[key] = compute(key)
            return value

    return Cache()


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have at most so many short rows, broadcast if these are few: a join with it then deals no rows by its
    key, so that a hot key stays spread."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def drop_rows(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are not in ``dropped`` (doc_id, text_key); NULLs are equal.

    ``text_key`` is :func:`text_key` of the text. The short keys of up to ``BROADCAST_ROWS`` dropped rows are broadcast, so that
    texts are not shuffled; more are joined by a shuffle.
    """
    names = free_names(docs, "keep_id", "keep_key")
    keys = materialize(dropped.select(*[c.alias(n) for c, n in zip(_row_key(F.col("doc_id"), F.col("text_key")), names)]).distinct())
    n = keys.count()
    if not n:
        return docs
    rows = docs.withColumns(dict(zip(names, _row_key(F.col(id_col), text_key(text_col)))))
    return rows.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, names, "left_anti").select(*docs.columns)


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept by ``decided`` (doc_id, text_key, kept; a row for every row of ``docs``), each pair of
    id and text once; NULLs are equal.

    Of rows that repeat id and text, which cannot be told apart, one stays if any is kept.
    """
    pairs = decided.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    pairs = materialize(pairs.where("NOT kept OR n > 1"))
    found = drop_rows(docs, pairs.where("NOT kept"), id_col, text_col)
    repeated = pairs.where("kept")
    if repeated.isEmpty():
        return found
    names = free_names(docs, "keep_id", "keep_key")
    rows = found.withColumns(dict(zip(names, _row_key(F.col(id_col), text_key(text_col)))))
    again = repeated.select(*[c.alias(n) for c, n in zip(_row_key(F.col("doc_id"), F.col("text_key")), names)])
    return rows.join(again, names, "left_anti").unionByName(
        rows.join(again, names, "left_semi").dropDuplicates(names)).select(*docs.columns)


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def _row_key(doc_id: Column, key: Column) -> tuple[Column, Column]:
    """Never NULL: a NULL id is the text "-", which no number is written as."""
    return F.coalesce(doc_id.cast("string"), F.lit("-")), key
