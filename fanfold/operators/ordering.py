"""Positions, prefix sums and neighbours in an order, without putting a group into one task.

A plain window over a group that holds a third of all rows would run in a single task. Two ways
round it are used here:

* :func:`prefix_sum` range-sorts the whole frame, so a large group spans many partitions, and adds
  up per (partition, group) chunk totals;
* :func:`previous_row` sorts in the same way and carries the last row of a partition over its edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fanfold.session import materialize

_ROW, _PART, _KEY, _FIRST, _TOTAL, _BEFORE = "__row", "__part", "__key", "__first", "__total", "__before"


def key_of(keys: Sequence[str]) -> Column:
    """The keys as one struct, which is never NULL itself and equal where its fields are, NULLs too.

    Windows, aggregates and joins on it share one partitioning; a null-safe comparison of the
    single columns would shuffle once more for the join.
    """
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns whose definitions are evaluated once per row.

    A filter on a plain derived column is pushed down by inserting the column's definition, so an
    expensive regex runs once more for every mention. Filters stay above a generator, and this one
    gives exactly one row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def prefix_sum(df: DataFrame, group: Sequence[str], order_by: Sequence[str | Column],
               weight: str | None = None, name: str = "position") -> DataFrame:
    """Sum of ``weight`` over the earlier rows of the group (their number without ``weight``).

    ``order_by`` must be total within a group. The sorted frame is written once to the shared
    folder, because the chunk totals and the rows must come from the same partitioning.
    """
    group = list(group)
    ordered = materialize(df.orderBy(*group, *order_by)
                          .withColumn(_ROW, F.monotonically_increasing_id()))
    rows = ordered.withColumns({_PART: F.shiftrightunsigned(_ROW, 33), _KEY: key_of(group)})
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    chunks = rows.groupBy(_KEY, _PART).agg(F.min(_ROW).alias(_FIRST), total.alias(_TOTAL))
    # At most one row per (group, partition): the window holds as many rows as there are partitions.
    earlier = W.partitionBy(_KEY).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = chunks.select(_KEY, _PART, _FIRST,
                            F.coalesce(F.sum(_TOTAL).over(earlier), F.lit(0)).alias(_BEFORE))
    if weight is None:
        inside = F.col(_ROW) - F.col(_FIRST)
    else:
        local = W.partitionBy(_KEY, _PART).orderBy(_ROW).rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("__local", F.coalesce(F.sum(weight).over(local), F.lit(0)))
        inside = F.col("__local")
    joined = rows.join(offsets, [_KEY, _PART])
    return joined.withColumn(name, F.col(_BEFORE) + inside).select(*df.columns, name)


def number_rows(ordered: DataFrame, name: str) -> DataFrame:
    """1, 2, 3, … over a frame that has just been ordered as a whole."""
    rows = materialize(ordered.withColumn(_ROW, F.monotonically_increasing_id())).withColumn(_PART, F.shiftrightunsigned(_ROW, 33))
    # One row per partition enters the window.
    sizes = rows.groupBy(_PART).agg(F.count(F.lit(1)).alias(_TOTAL), F.min(_ROW).alias(_FIRST))
    earlier = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(_PART, _FIRST, F.coalesce(F.sum(_TOTAL).over(earlier), F.lit(0)).alias(_BEFORE))
    return rows.join(before, _PART).select(*ordered.columns, (F.col(_BEFORE) + F.col(_ROW) - F.col(_FIRST) + 1).alias(name))


def dense_index(df: DataFrame, order_by: Sequence[str | Column], name: str = "task_index") -> DataFrame:
    """0, 1, 2, … over the whole frame in a total order."""
    return prefix_sum(df, [], order_by, name=name)


def previous_row(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Adds ``prev_<value>`` of the row before, per ``keys`` in the order of ``order_by``.

    The frame is range-sorted, so one key's rows span as many partitions as they fill, however close they lie in time. The
    lag runs per (key, partition); the last row of each (key, partition) enters one small window, which carries it over
    the partition's edge. The sorted frame is written once to the shared folder, as for :func:`prefix_sum`. Rows that
    are equal in all these columns are told apart by their place, so that they can be spread as well.
    """
    keys, values = list(keys), list(values)
    placed = df.withColumn("__place", F.monotonically_increasing_id()).orderBy(*keys, *order_by, "__place")
    ordered = materialize(placed.drop("__place").withColumn(_ROW, F.monotonically_increasing_id()))
    rows = ordered.withColumns({_PART: F.shiftrightunsigned(_ROW, 33), _KEY: key_of(keys)})
    local = W.partitionBy(_KEY, _PART).orderBy(_ROW)
    lagged = rows.select("*", F.row_number().over(local).alias("__nth"),
                         *[F.lag(v).over(local).alias(f"__lag_{v}") for v in values])
    # At most one row per (key, partition).
    ends = rows.groupBy(_KEY, _PART).agg(F.max_by(F.struct(*values), _ROW).alias("__last"))
    carried = ends.select(_KEY, _PART, F.lag("__last").over(W.partitionBy(_KEY).orderBy(_PART)).alias("__carry"))
    previous = [F.when(F.col("__nth") == 1, F.col("__carry")[v]).otherwise(F.col(f"__lag_{v}")).alias(f"prev_{v}")
                for v in values]
    return lagged.join(carried, [_KEY, _PART]).select(*df.columns, *previous)
