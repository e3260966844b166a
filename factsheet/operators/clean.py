"""Turn columns of malformed numbers into numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsheet.functions.columns import ROW_INDEX, col, key_columns
from factsheet.functions.session import staged
from factsheet.functions.text import clean_number

SAMPLE = 10
WANTED_RATIO = 0.5


def columns_with_digits(
    df: DataFrame, columns: Sequence[str], key: str | Sequence[str] = ROW_INDEX, sample: int | None = SAMPLE
) -> list[str]:
    """Columns where one of the first ``sample`` non-missing values holds a digit; all with None.

    One bounded heap per column (TakeOrderedAndProject over that column and the key);
    ``sample`` short rows per column reach the driver.
    """
    if sample is None:
        return list(columns)
    keys = [col(k) for k in key_columns(df, key)]
    heads = [
        df.select(*keys, col(c).alias("v"))
        .filter(F.col("v").isNotNull())
        .orderBy(*keys)
        .limit(sample)
        .select(F.lit(c).alias("column"), F.col("v").rlike(r"\p{Nd}").alias("digit"))
        for c in columns
    ]
    if not heads:
        return []
    found = reduce(DataFrame.unionByName, heads).groupBy("column").agg(F.bool_or("digit").alias("digit"))
    hits = {r["column"] for r in found.collect() if r["digit"]}
    return [c for c in columns if c in hits]


def number_columns(
    df: DataFrame, key: str | Sequence[str] = ROW_INDEX, exclude: Sequence[str] = (), sample: int | None = SAMPLE
) -> list[str]:
    """Text columns that cleaning replaces: more than half of all rows read as numbers."""
    keys = key_columns(df, key)
    text = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in exclude and f.name not in keys
    ]
    candidates = columns_with_digits(df, text, keys, sample)
    if not candidates:
        return []
    ratios = df.agg(
        *[
            F.try_divide(F.count(clean_number(col(c))), F.count(F.lit(1))).alias(f"r{i}")
            for i, c in enumerate(candidates)
        ]
    ).first()
    return [c for i, c in enumerate(candidates) if (ratios[f"r{i}"] or 0.0) > WANTED_RATIO]


def clean_by_file(
    df: DataFrame, by: str = "file_id", key: str = ROW_INDEX, exclude: Sequence[str] = (), sample: int | None = SAMPLE
) -> list[DataFrame]:
    """``clean_table`` for many tables of the same columns, told apart by ``by``: one frame for each outcome.

    What each table needs is decided for all of them together, and only the outcomes reach the driver.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in (*exclude, by, key)]
    if not text:
        return [df]
    readable = [(F.try_divide(F.count(clean_number(col(c))), F.count(F.lit(1))) > WANTED_RATIO) for c in text]
    wanted = staged(df.groupBy(by).agg(F.array(*[F.coalesce(r, F.lit(False)) for r in readable]).alias("_wanted")), "wanted")
    if sample is not None and not wanted.filter(F.array_contains("_wanted", True)).isEmpty():
        # The first values of each column that may be replaced; every task hands over that many.
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("v")) for i, c in enumerate(text)])).alias("e")
        long = df.join(wanted, by).select(by, F.col(key).alias("_k"), "_wanted", cells).filter("e.v is not null and _wanted[e.i]")
        first = W.partitionBy(by, "e.i").orderBy("_k")
        heads = long.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= sample)
        digits = heads.groupBy(by, F.col("e.i").alias("i")).agg(F.bool_or(F.col("e.v").rlike(r"\p{Nd}")).alias("d")).filter("d")
        held = digits.groupBy(by).agg(F.collect_set("i").alias("_held"))
        both = F.transform("_wanted", lambda w, i: w & F.coalesce(F.array_contains("_held", i), F.lit(False)))
        wanted = staged(wanted.join(held, by, "left").select(by, both.alias("_wanted")), "wanted")
    outcomes = sorted(r["_wanted"] for r in wanted.select("_wanted").distinct().collect())
    frames = []
    for outcome in outcomes:
        chosen = [c for c, w in zip(text, outcome) if w]
        here = df if len(outcomes) == 1 else df.join(wanted.filter(F.col("_wanted") == F.array(*map(F.lit, outcome))).select(by), by, "left_semi")
        frames.append(here.select(*[clean_number(col(c)).alias(c) if c in chosen else col(c) for c in df.columns]))
    return frames


def clean_table(
    df: DataFrame, key: str | Sequence[str] = ROW_INDEX, exclude: Sequence[str] = (), sample: int | None = SAMPLE
) -> DataFrame:
    """The table with its number-like text columns rewritten as doubles.

    A column is looked at if one of its first ``sample`` values holds a digit; with None the share of
    readable values in all rows decides alone.

    ISO dates become years and ``Brand#12`` becomes 12.0: name such columns in ``exclude``
    to keep them as text.
    """
    chosen = number_columns(df, key, exclude, sample)
    return df.select(
        *[clean_number(col(c)).alias(c) if c in chosen else col(c) for c in df.columns]
    )
