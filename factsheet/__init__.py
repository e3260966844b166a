"""Questions about tables and documents, answered by Spark."""

import sys

from pyspark import cloudpickle

from factsheet.operators.answer import Answer
from factsheet.operators.catalog import (
    catalog_summary,
    list_documents,
    list_tables,
    load_report,
    samples,
    status,
    status_counts,
    table_catalog,
)
from factsheet.operators.clean import clean_table
from factsheet.operators.compare import compare_averages
from factsheet.operators.documents import chunk_text, document_metadata, document_units, extract_qa
from factsheet.operators.embed import embed_text, row_units
from factsheet.operators.profile import (
    categorical_summary,
    column_summaries,
    numeric_summary,
    table_fingerprint,
    table_profile,
)
from factsheet.operators.search import document_context, document_query, explain_row, nearest
from factsheet.operators.select import compare_top, filter_rows, filter_threshold, ranks, sample_head, sort_data, top_n
from factsheet.plans.ingest import ingest_documents, ingest_table, load_files

# Task functions travel with their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "Answer",
    "catalog_summary",
    "categorical_summary",
    "chunk_text",
    "clean_table",
    "column_summaries",
    "compare_averages",
    "compare_top",
    "document_context",
    "document_metadata",
    "document_query",
    "document_units",
    "embed_text",
    "explain_row",
    "extract_qa",
    "filter_rows",
    "filter_threshold",
    "ingest_documents",
    "ingest_table",
    "list_documents",
    "list_tables",
    "load_files",
    "load_report",
    "nearest",
    "numeric_summary",
    "row_units",
    "ranks",
    "sample_head",
    "samples",
    "sort_data",
    "status",
    "status_counts",
    "table_catalog",
    "table_fingerprint",
    "table_profile",
    "top_n",
]
