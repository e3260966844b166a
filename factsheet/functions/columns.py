"""Naming and typing helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_INDEX = "_row_index"


def col(name: str) -> Column:
    """Column by its literal name, so that a dot in a header is not struct access."""
    return F.col("`" + name.replace("`", "``") + "`")


def sql_text(s: str) -> str:
    """A string as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values: Sequence[str]) -> Column:
    """A constant list of strings; one expression, however long the list."""
    return F.expr(f"cast(array({', '.join(map(sql_text, values))}) as array<string>)")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column not found: {', '.join(missing)}; table has {df.columns}")


def is_numeric(dtype: T.DataType) -> bool:
    """Booleans count as numeric; dates, timestamps and strings are text."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def require_numeric(df: DataFrame, name: str) -> None:
    require(df, name)
    if not is_numeric(df.schema[name].dataType):
        raise ValueError(f"column {name} is not numeric")


def split_columns(df: DataFrame, skip: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, text) column names in schema order."""
    fields = [f for f in df.schema.fields if f.name not in skip]
    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    return numeric, [f.name for f in fields if f.name not in numeric]


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing; non-floating columns are returned bare."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def measure(df: DataFrame, name: str) -> Column:
    """``value`` as something that can be averaged (booleans become 0/1)."""
    v = value(df, name)
    return v.cast("int") if isinstance(df.schema[name].dataType, T.BooleanType) else v


def key_columns(df: DataFrame, key: str | Sequence[str]) -> list[str]:
    keys = [key] if isinstance(key, str) else list(key)
    require(df, *keys)
    return keys


def key_value(keys: Sequence[str]) -> Column:
    """The row identity as one column: the key itself, or a struct of a composite key."""
    return col(keys[0]) if len(keys) == 1 else F.struct(*[col(k) for k in keys])


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Put one-row frames next to each other without a join."""
    names = [n for f in frames for n in f.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.first(col(n), ignorenulls=True).alias(n) for n in names])
