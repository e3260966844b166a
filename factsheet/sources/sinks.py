"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsheet.functions.columns import col


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; nested cells are written as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    cells = [
        F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else col(f.name)
        for f in df.schema.fields
    ]
    df.select(*cells).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row; missing cells are written as null."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
