"""Filter by threshold, sort, top and bottom N, sample head.

``key`` names the column (or columns) that identify a row and give the table its order;
tables ingested from CSV carry ``_row_index``. Ties are always broken by the key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsheet.functions.columns import (
    ROW_INDEX,
    col,
    key_columns,
    key_value,
    measure,
    require,
    require_numeric,
    side_by_side,
    texts,
    value,
)
from factsheet.functions.positions import HEAP_ROWS, first_places, positions
from factsheet.operators.answer import Answer

FIRST_ROWS = 100
#: Lists among the numbers have at most so many values; ranks of any number are frames.
LISTED = 1000

COMPARISONS = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: ~c.eqNullSafe(v),
}


def _predicate(df: DataFrame, column: str, op: str, threshold: float) -> Column:
    if op not in COMPARISONS:
        raise ValueError(f"invalid operator: {op}; use one of {list(COMPARISONS)}")
    require_numeric(df, column)
    dtype = df.schema[column].dataType.typeName()
    c = col(column).cast("int") if dtype == "boolean" else col(column)
    if dtype in ("byte", "short", "integer", "long"):
        return _integral(c, op, float(threshold))
    test = COMPARISONS[op](c, F.lit(float(threshold)))
    # Spark orders NaN above every number; a missing value only ever satisfies !=.
    if op in (">", ">=", "==") and dtype in ("double", "float"):
        test = test & ~F.isnan(c)
    return test


def _integral(c: Column, op: str, threshold: float) -> Column:
    """A comparison of integers with an integer, which is exact and reaches the scan.

    Compared with a double, Spark would cast the column, and round it beyond 2^53.
    """
    if op == "!=":
        return ~c.eqNullSafe(F.lit(int(threshold))) if threshold.is_integer() and abs(threshold) < 2**63 else F.lit(True)
    if math.isnan(threshold) or (op == "==" and not threshold.is_integer()):
        return F.lit(False)
    if abs(threshold) >= 2**63:
        above = (threshold > 0) == (op in ("<", "<="))
        return c.isNotNull() if above and op != "==" else F.lit(False)
    bound = math.ceil(threshold) if op in ("<", ">=") else math.floor(threshold)
    return COMPARISONS[op](c, F.lit(bound).cast("bigint"))


def filter_rows(df: DataFrame, column: str, op: str, threshold: float) -> DataFrame:
    """Every matching row; the comparison reaches the parquet scan as a pushed filter."""
    return df.filter(_predicate(df, column, op, threshold))


def filter_threshold(
    df: DataFrame,
    column: str,
    op: str,
    threshold: float,
    key: str | Sequence[str] = ROW_INDEX,
    first_rows: int = FIRST_ROWS,
) -> Answer:
    """The first ``first_rows`` matching rows in row order, and how many rows match."""
    keys = key_columns(df, key)
    test = _predicate(df, column, op, threshold)
    first = df.filter(test).orderBy(*[col(k) for k in keys]).limit(first_rows)
    counts = df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(test).alias("filtered_rows")
    ).select(
        "total_rows",
        "filtered_rows",
        F.lit(column).alias("filter_column"),
        F.lit(op).alias("filter_operator"),
        F.lit(float(threshold)).alias("filter_value"),
        F.when(F.col("total_rows") > 0, F.col("filtered_rows") * 100.0 / F.col("total_rows"))
        .otherwise(F.lit(0.0))
        .alias("percentage_matched"),
    )
    indices = first.select(*[col(k) for k in keys]).agg(
        F.array_sort(F.collect_list(key_value(keys))).alias("row_indices")
    )
    return Answer(first, side_by_side(counts, indices))


def _order(df: DataFrame, column: str, keys: Sequence[str], ascending: bool) -> list[Column]:
    v = value(df, column)
    return [v.asc_nulls_last() if ascending else v.desc_nulls_last(), *[col(k) for k in keys]]


def _ends(df: DataFrame, column: str, ascending: bool) -> tuple[Column, Column]:
    """First and last value of a sorted column; missing values sort last both ways."""
    v = value(df, column)
    low, high = F.min(v), F.max(v)
    full = F.count(v) == F.count(F.lit(1))
    return (low, F.when(full, high)) if ascending else (high, F.when(full, low))


def sort_data(
    df: DataFrame,
    column: str,
    ascending: bool = True,
    limit: int | None = None,
    key: str | Sequence[str] = ROW_INDEX,
    listed: int = LISTED,
) -> Answer:
    """Sorted rows; ``limit`` of None or 0 keeps all of them.

    Without a limit the row indices are the key column of the (range-partitioned) result; with one they
    are the ids of ``ranked``, and up to ``listed`` of them also a list among the numbers.
    """
    require(df, column)
    keys = key_columns(df, key)
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    labels = [F.lit(column).alias("sort_column"), F.lit(ascending).alias("ascending")]
    if not limit:
        first, last = _ends(df, column, ascending)
        numbers = df.agg(
            F.count(F.lit(1)).alias("total_rows"), first.alias("first_value"), last.alias("last_value")
        ).select("total_rows", F.col("total_rows").alias("returned_rows"), *labels, "first_value", "last_value")
        return Answer(df.orderBy(*_order(df, column, keys, ascending)), numbers)
    rows, ranked = _first(df, column, limit, ascending, keys)
    figures = [F.count(F.lit(1)).alias("returned_rows"), F.min_by("value", "rank").alias("first_value"), F.max_by("value", "rank").alias("last_value")]
    picked = ranked.agg(*figures, *_lists(limit, listed, row_indices="id"))
    indices = ["row_indices"] if limit <= listed else []
    picked = picked.select("returned_rows", *labels, "first_value", "last_value", *indices)
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return Answer(rows, side_by_side(total, picked), ranked)


def ranks(
    df: DataFrame, column: str, n: int | None = None, ascending: bool = False, key: str | Sequence[str] = ROW_INDEX
) -> DataFrame:
    """(rank, value, id) of the first n rows of a sorted table, or of all; any number of them."""
    keys = key_columns(df, key)
    require(df, column)
    order = _order(df, column, keys, ascending)
    narrow = df.select(col(column), *[col(k) for k in keys if k != column])
    placed = positions(narrow, order, "_rank") if n is None else first_places(narrow, order, n, "_rank")
    return placed.select(F.col("_rank").alias("rank"), value(df, column).alias("value"), key_value(keys).alias("id"))


def _first(df: DataFrame, column: str, n: int, ascending: bool, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The first n rows, and their (rank, value, id)."""
    if n <= HEAP_ROWS:
        return top_rows(df, column, n, ascending, keys), ranks(df, column, n, ascending, keys)
    # Stored once with their places; both frames read them there.
    placed = first_places(df, _order(df, column, keys, ascending), n, "_rank")
    ranked = placed.select(F.col("_rank").alias("rank"), value(df, column).alias("value"), key_value(keys).alias("id"))
    return placed.orderBy("_rank").drop("_rank"), ranked


def _lists(n: int, listed: int, where: Column | None = None, **lists: str) -> list[Column]:
    """Ordered lists of columns of a ranked frame, where n is small enough to be listed."""
    if n > listed:
        return []
    pairs = F.struct("rank", *sorted(set(lists.values())))
    found = F.array_sort(F.collect_list(pairs if where is None else F.when(where, pairs)))
    return [found[c].alias(name) for name, c in lists.items()]


def top_rows(
    df: DataFrame, column: str, n: int, ascending: bool = False, key: str | Sequence[str] = ROW_INDEX
) -> DataFrame:
    if n <= 0:
        raise ValueError("n must be positive")
    keys = key_columns(df, key)
    return df.orderBy(*_order(df, column, keys, ascending)).limit(n)


def top_n(
    df: DataFrame,
    column: str,
    n: int,
    ascending: bool = False,
    key: str | Sequence[str] = ROW_INDEX,
    listed: int = LISTED,
) -> Answer:
    """The n highest (or lowest) rows, their ranks, and the figures of that list.

    ``highest_value`` is the first of the list, so the lowest value when ascending;
    ``average_of_top`` is null when one of the n values is missing. Up to ``listed`` values and
    indices are also lists among the numbers.
    """
    require_numeric(df, column)
    keys = key_columns(df, key)
    if n <= 0:
        raise ValueError("n must be positive")
    rows, ranked = _first(df, column, n, ascending, keys)
    found = ranked.agg(
        *_lists(n, listed, top_values="value", top_indices="id"),
        F.min_by("value", "rank").alias("highest_value"),
        F.max_by("value", "rank").alias("lowest_in_top"),
        F.when(F.count(F.lit(1)) == F.count("value"), F.avg(F.col("value").cast("double"))).alias("average_of_top"),
    )
    return Answer(rows, found.select(F.lit(n).alias("n"), F.lit(column).alias("column"), "*"), ranked)


def compare_top(
    df1: DataFrame,
    df2: DataFrame,
    column: str,
    n: int,
    names: tuple[str, str] = ("file1", "file2"),
    key: str | Sequence[str] = ROW_INDEX,
    listed: int = LISTED,
) -> Answer:
    """The n largest of the same column in two tables, side by side for ranks 1 to n."""
    if n <= 0:
        raise ValueError("n must be positive")
    sides = []
    for side, df in enumerate((df1, df2)):
        require_numeric(df, column)
        top = ranks(df, column, n, False, key)
        sides.append(top.select(F.lit(side).alias("side"), "rank", measure(top, "value").alias("v"), "id"))
    both = sides[0].unionByName(sides[1])

    def of(side: int, c: str) -> Column:
        return F.when(F.col("side") == side, F.col(c))

    every = df1.sparkSession.range(1, n + 1).select(F.col("id").alias("rank"))
    result = (
        both.unionByName(every, allowMissingColumns=True)
        .groupBy(F.col("rank").cast("int").alias("rank"))
        .agg(
            *[
                F.max(of(side, c)).alias(f"{name}_{label}")
                for side, name in enumerate(names)
                for c, label in (("v", column), ("id", "index"))
            ]
        )
        .orderBy("rank")
    )
    figures = []
    for side, name in enumerate(names):
        figures += [
            *_lists(n, listed, F.col("side") == side, **{f"{name}_top_values": "v"}),
            F.avg(of(side, "v")).alias(f"{name}_average"),
            F.max(of(side, "v")).alias(f"{name}_max"),
        ]
    numbers = both.agg(F.first(F.lit(n)).alias("n"), F.first(F.lit(column)).alias("column"), *figures)
    ranked = both.select(F.element_at(texts(names), F.col("side") + 1).alias("file"), "rank", F.col("v").alias("value"), "id")
    return Answer(result, numbers, ranked)


def sample_head(df: DataFrame, n: int = 3, key: str | Sequence[str] = ROW_INDEX) -> DataFrame:
    """The first rows of a table in row order."""
    return df.orderBy(*[col(k) for k in key_columns(df, key)]).limit(n)
