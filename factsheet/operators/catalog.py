"""What is loaded: lists of tables and documents, status, totals, load report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsheet.functions.columns import ROW_INDEX, col, key_columns
from factsheet.operators.clean import clean_table
from factsheet.operators.profile import profiles, table_fingerprint
from factsheet.operators.select import sample_head

# The supported questions.
INTENTS = (
    "compare_averages",
    "filter_threshold",
    "sort",
    "top_n",
    "compare_top",
    "explain_row",
    "general_query",
    "document_query",
)


def table_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One profile row per table, keyed by file id."""
    if not tables:
        raise ValueError("no data loaded")
    named = [(df, file_id, f"{file_id}.csv") for file_id, df in tables.items()]
    return profiles(named, skip=(ROW_INDEX, "file_id"))


# The output names of both lists.
def list_tables(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        "file_id", "filename", F.col("num_rows").alias("rows"), F.col("num_columns").alias("columns"), "numeric_columns"
    )


def list_documents(metadata: DataFrame) -> DataFrame:
    return metadata.select(
        "file_id",
        "filename",
        F.col("document_type").alias("type"),
        F.col("num_characters").alias("characters"),
        F.col("num_chunks").alias("chunks"),
        F.col("num_qa_pairs").alias("qa_pairs"),
    )


def catalog_summary(catalog: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: number of tables, number of documents, rows in all tables."""
    marked = catalog.select(F.lit(True).alias("is_table"), "num_rows").unionByName(
        documents.select(F.lit(False).alias("is_table"), F.lit(0).cast("bigint").alias("num_rows"))
    )
    return marked.agg(
        F.count_if("is_table").alias("csv_files"),
        F.count_if(~F.col("is_table")).alias("document_files"),
        F.coalesce(F.sum("num_rows"), F.lit(0)).alias("total_rows"),
    )


def samples(tables: Mapping[str, DataFrame], keys: Mapping[str, str | Sequence[str]], n: int = 3) -> dict[str, DataFrame]:
    """First rows of a table, or of the first two when several are loaded."""
    return {name: sample_head(df, n, keys.get(name, ROW_INDEX)) for name, df in list(tables.items())[:2]}


def status(catalog: DataFrame, documents: DataFrame, stores: DataFrame) -> DataFrame:
    """(kind, id): every table, document, vector store and supported question."""
    intents = F.explode(F.array(*[F.lit(i) for i in INTENTS]))
    one = catalog.sparkSession.range(1)
    parts = [
        catalog.select(F.lit("table").alias("kind"), F.col("file_id").cast("string").alias("id")),
        documents.select(F.lit("document").alias("kind"), F.col("file_id").cast("string").alias("id")),
        stores.select(F.lit("vector_store").alias("kind"), F.col("file_id").cast("string").alias("id")),
        one.select(F.lit("intent").alias("kind"), intents.alias("id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def status_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def load_report(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, str | Sequence[str]],
    documents: DataFrame | None = None,
    errors: Mapping[str, tuple[str, str]] | None = None,
    clean: bool = True,
    ids: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per source: file id, status, shape as read, shape after cleaning, fingerprint, type, error.

    ``errors`` has (type, message) of what failed; ``ids`` the file ids of tables, by default their names.
    Cleaning changes cells only, so both shapes come from one pass over the cleaned table.
    """
    parts = []
    for name, df in tables.items():
        keep = [c for c in df.columns if c not in (ROW_INDEX, "file_id")]
        cleaned = clean_table(df, key_columns(df, keys.get(name, ROW_INDEX))) if clean else df
        parts.append(
            table_fingerprint(cleaned.select(*map(col, keep))).select(
                F.lit(name).alias("name"),
                F.lit((ids or {}).get(name, name)).alias("file_id"),
                F.lit("success").alias("status"),
                F.col("num_rows").alias("rows_read"),
                F.lit(len(keep)).alias("columns_read"),
                F.col("num_rows").alias("rows_cleaned"),
                F.lit(len(keep)).alias("columns_cleaned"),
                "fingerprint",
                F.lit("csv").alias("type"),
                F.lit(None).cast("string").alias("error"),
            )
        )
    if documents is not None:
        parts.append(
            documents.select(
                F.col("filename").alias("name"),
                F.col("file_id").cast("string").alias("file_id"),
                F.lit("success").alias("status"),
                F.lit("document").alias("type"),
            )
        )
    if errors:
        spark = (documents if documents is not None else next(iter(tables.values()))).sparkSession
        failed = [
            F.struct(
                F.lit(n).alias("name"), F.lit("error").alias("status"), F.lit(kind).alias("type"), F.lit(e).alias("error")
            )
            for n, (kind, e) in errors.items()
        ]
        parts.append(spark.range(1).select(F.inline(F.array(*failed))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
