"""Positions in an order, without a window or a list in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsheet.functions.session import staged

#: First rows that are kept in a bounded heap by each task; longer lists are range-partitioned.
HEAP_ROWS = 10_000
#: monotonically_increasing_id has the task above these bits and the row in the task below.
TASK_BITS = 33


def positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Every row with its place, counted from 1, in the given order.

    Rows are dealt out by ranges of the order and numbered inside each range as they are written; a place is
    that number plus the rows of all earlier ranges. Rows that the order leaves equal are told apart by where
    they were read, so they may lie in several ranges.
    """
    rows = df.withColumn("_read", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*order, F.col("_read")).sortWithinPartitions(*order, F.col("_read"))
    stored = staged(ranged.drop("_read").withColumn("_at", F.monotonically_increasing_id()), "ranges")
    task = F.shiftright("_at", TASK_BITS)
    sizes = sorted(stored.groupBy(task.alias("t")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for t, n in sizes:
        before.append((t, total))
        total += n
    # One row for each range, that is for each shuffle partition.
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_task bigint, _before bigint"))
    place = F.col("_at").bitwiseAND((1 << TASK_BITS) - 1) + F.col("_before") + 1
    return stored.join(offsets, task == F.col("_task")).withColumn(name, place).drop("_at", "_task", "_before")


def first_places(df: DataFrame, order: Sequence[Column], n: int, name: str) -> DataFrame:
    """The first n rows with their places."""
    if n > HEAP_ROWS:
        return positions(df, order, name).filter(F.col(name) <= n)
    # At most HEAP_ROWS rows are left for the window.
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(W.orderBy(*order)).cast("bigint"))
