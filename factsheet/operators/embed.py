"""Text to vectors, and the tables of texts that get one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsheet.functions.columns import ROW_INDEX, col, require
from factsheet.functions.hashing import token_buckets
from factsheet.functions.text import STORED_TEXT_LIMIT, row_text, stored_text
from factsheet.functions.vectors import dense_counts
from factsheet.operators.profile import column_summaries

DIMENSION = 256


def embed_text(
    df: DataFrame,
    text: str,
    dimension: int = DIMENSION,
    output: str = "embedding",
    encoder: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add a unit-length vector of a text column; documents and queries use the same one.

    The default is a hashed bag of words: words are hashed to buckets by Spark expressions
    and counted into dense vectors per Arrow batch, with no shuffle. ``encoder`` replaces it
    by any function from a text column to an array<float> column, for example a model in a
    pandas UDF.
    """
    require(df, text)
    if encoder is not None:
        return df.withColumn(output, encoder(col(text)))
    return df.withColumn(output, dense_counts(token_buckets(col(text), dimension), dimension))


def row_units(
    df: DataFrame,
    file_id: str,
    key: str = ROW_INDEX,
    columns: Sequence[str] | None = None,
    with_summaries: bool = True,
    stored: int | None = STORED_TEXT_LIMIT,
    by_file: bool = False,
) -> DataFrame:
    """The units of a table that get a vector: one per row, and one per column (row_idx -1).

    Rows of a table that has a ``file_id`` column keep theirs; ``file_id`` names the others and the
    summaries. ``by_file`` makes summaries for each of the small tables that ``file_id`` tells apart.
    """
    require(df, key)
    names = list(columns if columns is not None else [c for c in df.columns if c not in (ROW_INDEX, "file_id")])
    full = row_text(df, names)
    rows = df.select(
        (F.coalesce(F.col("file_id").cast("string"), F.lit(file_id)) if "file_id" in df.columns else F.lit(file_id)).alias("file_id"),
        col(key).cast("bigint").alias("row_idx"),
        F.lit(None).cast("string").alias("column_name"),
        F.lit(True).alias("is_row_vector"),
        full.alias("full_text"),
        stored_text(full, stored).alias("original_text"),
    )
    if not with_summaries:
        return rows
    # A summary is stored whole, a row text up to ``stored`` characters (None: whole).
    summaries = column_summaries(df, names, key, by="file_id" if by_file else None)
    return rows.unionByName(
        summaries.select(
            F.col("file_id") if by_file else F.lit(file_id).alias("file_id"),
            F.lit(-1).cast("bigint").alias("row_idx"),
            "column_name",
            F.lit(False).alias("is_row_vector"),
            F.col("summary").alias("full_text"),
            F.col("summary").alias("original_text"),
        )
    )
