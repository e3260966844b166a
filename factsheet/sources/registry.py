"""The catalog on disk: one row for each table or document that a load brought, appended by every load.

A source that is loaded again gets a new row; the last one counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = (
    "file_id string, filename string, kind string, type string, num_rows bigint, num_columns int, columns array<string>, "
    "column_types map<string,string>, numeric_columns array<string>, text_columns array<string>, num_characters bigint, "
    "num_chunks int, num_qa_pairs int, has_questions boolean, ingestion_timestamp timestamp"
)


def add_entries(entries: DataFrame, path: str) -> None:
    """Append what a load brought; columns that an entry lacks are missing."""
    none = entries.sparkSession.createDataFrame([], ENTRY)
    rows = none.unionByName(entries.withColumn("ingestion_timestamp", F.current_timestamp()), allowMissingColumns=True)
    rows.select(*none.columns).coalesce(1).write.mode("append").parquet(path)


def read_entries(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The last entry of each source; ``kind`` is ``table`` or ``document``."""
    rows = spark.read.schema(ENTRY).parquet(path)
    rows = rows if kind is None else rows.filter(F.col("kind") == kind)
    # Maps can't be compared, but an entry can be carried along whole.
    last = rows.groupBy("file_id").agg(F.max_by(F.struct(*rows.columns), "ingestion_timestamp").alias("e"))
    return last.select("e.*")
