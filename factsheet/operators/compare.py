"""Compare averages: across two tables, across the groups of one, or one table's figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsheet.functions.columns import measure, require, require_numeric, value
from factsheet.functions.text import printed
from factsheet.operators.answer import Answer


def compare_averages(
    df: DataFrame,
    column: str,
    other: DataFrame | None = None,
    group_by: str | None = None,
    names: tuple[str, str] = ("file1", "file2"),
) -> Answer:
    if other is not None:
        if names[0] == names[1]:
            raise ValueError("the two tables need different names")
        return _two_tables(df, other, column, names)
    if group_by is not None:
        return _groups(df, column, group_by)
    return _single(df, column)


def _two_tables(df1: DataFrame, df2: DataFrame, column: str, names: tuple[str, str]) -> Answer:
    parts = []
    for name, df in zip(names, (df1, df2)):
        require_numeric(df, column)
        parts.append(
            df.agg(F.avg(measure(df, column)).alias("average")).select(F.lit(name).alias("file_id"), "average")
        )
    result = parts[0].unionByName(parts[1])
    first, second = (F.max(F.when(F.col("file_id") == n, F.col("average"))) for n in names)
    pair = result.agg(first.alias("a"), second.alias("b"))
    numbers = pair.select(
        F.col("a").alias(f"{names[0]}_average"),
        F.col("b").alias(f"{names[1]}_average"),
        (F.col("a") - F.col("b")).alias("difference"),
        F.when(F.col("b") == 0, F.lit(0.0))
        .otherwise(F.try_divide(F.col("a") - F.col("b"), F.col("b")) * 100)
        .alias("percent_difference"),
    )
    return Answer(result, numbers)


def _groups(df: DataFrame, column: str, group_by: str) -> Answer:
    """Mean per key; rows without a key count in the overall mean only.

    The result is the list of all means, however many there are; the numbers are the figures over it.

    Both frames start from the same partial sums, one row per key, so a key that holds a
    large share of the rows is reduced before the shuffle.
    """
    require_numeric(df, column)
    require(df, group_by)
    v = measure(df, column).cast("double")
    sums = df.groupBy(value(df, group_by).alias("key")).agg(F.sum(v).alias("total"), F.count(v).alias("n"))
    means = sums.withColumn("average", F.try_divide(F.col("total"), F.col("n")))
    named = F.col("key").isNotNull()
    result = (
        means.filter(named)
        .orderBy("key")
        .select(printed(F.col("key"), df.schema[group_by].dataType).alias(group_by), "average")
    )
    figures = means.agg(
        F.try_divide(F.sum("total"), F.sum("n")).alias("overall_average"),
        F.max(F.when(named, F.col("average"))).alias("max_average"),
        F.min(F.when(named, F.col("average"))).alias("min_average"),
    )
    return Answer(result, figures)


def _single(df: DataFrame, column: str) -> Answer:
    require_numeric(df, column)
    v = measure(df, column).cast("double")
    numbers = df.agg(
        F.avg(v).alias("average"),
        F.stddev_samp(v).alias("std_dev"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count(F.lit(1)).alias("count"),
    )
    result = numbers.withColumn("count", F.col("count").cast("double")).unpivot(
        [], ["average", "std_dev", "min", "max", "count"], "metric", "value"
    )
    return Answer(result, numbers)
