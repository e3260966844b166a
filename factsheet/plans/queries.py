"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame.

Lists are returned as joined text and computed doubles rounded, so that two engines can be
compared value by value.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from functools import reduce
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import factsheet as fs
from factsheet.functions.session import spread, staging_path
from factsheet.functions.text import clean_number, row_text, stored_text
from factsheet.functions.vectors import cosine, similarity
from factsheet.operators.search import document_numbers
from factsheet.sources.csv import read_csv
from factsheet.sources.documents import find_document, read_txt, scan_documents
from factsheet.sources.registry import read_entries
from factsheet.sources.sinks import write_csv, write_json
from factsheet.sources.vectors import add_vectors, compact, list_stores, read_vectors, store_stats, vectors_of_file
from factsheet.streaming.watch import watch_documents

Query = Callable[[SparkSession, str], DataFrame]

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
KEYS = {"customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey"}
LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
THRESHOLD = 4.29
DIMENSION = 256

QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def joined(values: str | Column, form: Callable[[Column], Column] = lambda x: x.cast("string")) -> Column:
    """A list as text; a missing element is printed as ``null``."""
    return F.array_join(F.transform(values, form), ",", "null")


def two_digits(x: Column) -> Column:
    return x.cast("decimal(18,2)").cast("string")


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Averages


def balances(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"))
    return c, s


NAMES = ("customer", "supplier")


@query("compare_averages_two")
def _(spark, sf):
    c, s = balances(spark, sf)
    return rounded(fs.compare_averages(c, "acctbal", s, names=NAMES).result, "average")


@query("compare_averages_two_numbers")
def _(spark, sf):
    c, s = balances(spark, sf)
    numbers = fs.compare_averages(c, "acctbal", s, names=NAMES).numbers
    return rounded(numbers, *numbers.columns)


@query("compare_averages_group")
def _(spark, sf):
    return rounded(
        fs.compare_averages(table(spark, sf, "lineitem"), "l_extendedprice", group_by="l_returnflag").result, "average"
    )


@query("compare_averages_group_numbers")
def _(spark, sf):
    numbers = fs.compare_averages(table(spark, sf, "lineitem"), "l_extendedprice", group_by="l_returnflag").numbers
    return rounded(numbers, "overall_average", "max_average", "min_average")


@query("compare_averages_many_groups")
def _(spark, sf):
    """Thousands of groups, all of them listed."""
    return rounded(fs.compare_averages(table(spark, sf, "orders"), "o_totalprice", group_by="o_custkey").result, "average")


@query("compare_averages_single")
def _(spark, sf):
    return rounded(fs.compare_averages(table(spark, sf, "lineitem"), "l_extendedprice").result, "value")


@query("compare_averages_single_numbers")
def _(spark, sf):
    return rounded(fs.compare_averages(table(spark, sf, "lineitem"), "l_extendedprice").numbers, "average", "std_dev")


# Filters, sorts, top lists. The value of error events is taken as missing.


def gapped_events(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf, "events").withColumn("value", value).withColumn("ts", F.col("ts").cast("string"))


COMPARISON_NAMES = {"gt": ">", "lt": "<", "ge": ">=", "le": "<=", "eq": "==", "ne": "!="}


def _filters(name: str, op: str) -> None:
    @query(f"filter_{name}")
    def _(spark, sf):
        return fs.filter_threshold(gapped_events(spark, sf), "value", op, THRESHOLD, key="event_id").result

    @query(f"filter_{name}_numbers")
    def _(spark, sf):
        numbers = fs.filter_threshold(gapped_events(spark, sf), "value", op, THRESHOLD, key="event_id").numbers
        return rounded(numbers, "percentage_matched").withColumn("row_indices", joined("row_indices"))


for _name, _op in COMPARISON_NAMES.items():
    _filters(_name, _op)


@query("filter_rows")
def _(spark, sf):
    """All matching rows, not only the first hundred."""
    return fs.filter_rows(table(spark, sf, "lineitem"), "l_quantity", ">=", 45).select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity"
    )


BIGINT_THRESHOLDS = {"integer": (">=", 3.0), "fraction": (">", 3.5), "beyond_doubles": ("<", 2.0**53 + 2), "not_equal": ("!=", 7.0)}


def _bigint_filters(name: str, op: str, threshold: float) -> None:
    @query(f"filter_bigint_{name}")
    def _(spark, sf):
        rows = fs.filter_rows(table(spark, sf, "events").select("event_id", "user_id"), "user_id", op, threshold)
        return rows.select("event_id", "user_id")


for _name, (_op, _threshold) in BIGINT_THRESHOLDS.items():
    _bigint_filters(_name, _op, _threshold)


@query("sort_asc")
def _(spark, sf):
    return fs.sort_data(gapped_events(spark, sf), "value", key="event_id").result


@query("sort_desc_limit")
def _(spark, sf):
    return fs.sort_data(gapped_events(spark, sf), "value", False, 25, "event_id").result


@query("sort_numbers")
def _(spark, sf):
    return fs.sort_data(gapped_events(spark, sf), "value", key="event_id").numbers


@query("sort_desc_limit_numbers")
def _(spark, sf):
    numbers = fs.sort_data(gapped_events(spark, sf), "value", False, 25, "event_id").numbers
    return numbers.withColumn("row_indices", joined("row_indices"))


@query("sort_text_numbers")
def _(spark, sf):
    return fs.sort_data(table(spark, sf, "part"), "p_name", key="p_partkey").numbers


def listed(numbers: DataFrame) -> DataFrame:
    return rounded(numbers, "average_of_top").withColumns(
        {"top_values": joined("top_values", two_digits), "top_indices": joined("top_indices")}
    )


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("top_n")
def _(spark, sf):
    return fs.top_n(table(spark, sf, "orders"), "o_totalprice", 5, key="o_orderkey").result.select(*ORDER_COLUMNS)


@query("bottom_n")
def _(spark, sf):
    return fs.top_n(table(spark, sf, "orders"), "o_totalprice", 5, True, "o_orderkey").result.select(*ORDER_COLUMNS)


@query("top_n_numbers")
def _(spark, sf):
    return listed(fs.top_n(table(spark, sf, "orders"), "o_totalprice", 5, key="o_orderkey").numbers)


@query("bottom_n_numbers")
def _(spark, sf):
    return listed(fs.top_n(table(spark, sf, "orders"), "o_totalprice", 5, True, "o_orderkey").numbers)


@query("top_n_lineitem")
def _(spark, sf):
    top = fs.top_n(table(spark, sf, "lineitem"), "l_extendedprice", 20, key=LINEITEM_KEY).result
    return top.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query("compare_top")
def _(spark, sf):
    return fs.compare_top(*balances(spark, sf), "acctbal", 10, NAMES, "id").result


@query("compare_top_numbers")
def _(spark, sf):
    numbers = fs.compare_top(*balances(spark, sf), "acctbal", 10, NAMES, "id").numbers
    lists = {f"{n}_top_values": joined(f"{n}_top_values", two_digits) for n in NAMES}
    return rounded(numbers.withColumns(lists), "customer_average", "supplier_average")


RANKED_KEY = ("l_orderkey", "l_linenumber", "l_quantity")


def half(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Line items, and half their number: lists that no task could hold on large tables."""
    rows = table(spark, sf, "lineitem")
    return rows, max(1, rows.count() // 2)


@query("top_half_ranks")
def _(spark, sf):
    rows, n = half(spark, sf)
    return fs.top_n(rows, "l_extendedprice", n, key=LINEITEM_KEY).ranked.select("rank", "value", *[f"id.{k}" for k in RANKED_KEY])


@query("top_half_numbers")
def _(spark, sf):
    rows, n = half(spark, sf)
    numbers = fs.top_n(rows, "l_extendedprice", n, True, LINEITEM_KEY, listed=0).numbers
    return rounded(numbers, "average_of_top").withColumn("n", F.col("n").cast("bigint"))


@query("sort_half_rows")
def _(spark, sf):
    rows, n = half(spark, sf)
    return fs.sort_data(rows, "l_extendedprice", True, n, LINEITEM_KEY).result.select(*RANKED_KEY, "l_extendedprice")


@query("rank_all_rows")
def _(spark, sf):
    """The place of every event in order of its value."""
    return fs.ranks(gapped_events(spark, sf), "value", None, True, "event_id")


@query("compare_top_half")
def _(spark, sf):
    rows, n = half(spark, sf)
    sides = [rows.filter(f"l_returnflag {op} 'N'").select(*LINEITEM_KEY) for op in ("=", "<>")]
    result = fs.compare_top(*sides, "l_extendedprice", n, ("new", "old"), LINEITEM_KEY).result
    return result.select(
        "rank", "new_l_extendedprice", "old_l_extendedprice",
        F.col("new_index.l_orderkey").alias("new_order"), F.col("old_index.l_orderkey").alias("old_order"),
    )


# Profiles


@query("profile_schema")
def _(spark, sf):
    profile = fs.table_profile(table(spark, sf, "part"), "part", "part.csv")
    types = F.transform("columns", lambda c: F.concat(c, F.lit("="), F.col("column_types")[c]))
    return profile.select(
        "file_id", "filename", "num_rows", "num_columns", joined("columns").alias("columns"),
        joined(types).alias("column_types"), joined("numeric_columns").alias("numeric_columns"),
        joined("text_columns").alias("text_columns"),
    )


@query("profile_numeric")
def _(spark, sf):
    summary = fs.numeric_summary(
        table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]
    )
    return rounded(summary, "min", "max", "mean", "median")


@query("profile_numeric_by_intervals")
def _(spark, sf):
    """The same figures by the interval search that large tables take."""
    summary = fs.numeric_summary(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_partkey"], small=100)
    return rounded(summary, "min", "max", "mean", "median")


@query("profile_categorical")
def _(spark, sf):
    summary = fs.categorical_summary(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey")
    return summary.withColumn("top_values", joined("top_values"))


@query("column_summaries")
def _(spark, sf):
    part = table(spark, sf, "part")
    return fs.column_summaries(part, part.columns, "p_partkey")


@query("row_text")
def _(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", row_text(c).alias("row_text"), stored_text(row_text(c)).alias("stored_text"))


@query("row_text_numbers_only")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return c.select("c_custkey", row_text(c).alias("row_text"))


@query("clean_numeric")
def _(spark, sf):
    o = spread(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"))
    return o.select(
        "o_orderkey",
        clean_number(F.col("o_orderpriority")).alias("priority"),
        clean_number(F.concat(F.lit("$ "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("-"))).alias(
            "negative_price"
        ),
    )


@query("clean_table")
def _(spark, sf):
    return fs.clean_table(table(spark, sf, "part"), "p_partkey")


@query("fingerprint")
def _(spark, sf):
    return fs.table_fingerprint(table(spark, sf, "customer"))


# Documents


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def qa_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation written in the question/answer format, one document per conversation."""
    turn = F.col("turn").cast("string")
    length = F.length("text").cast("string")
    piece = (
        F.when(F.col("role") == "user", F.concat(F.lit("Q"), turn, F.lit(": "), "text", F.lit("\n")))
        .when(
            F.col("role") == "assistant",
            F.concat(F.lit("\n\nAns: "), "text", F.lit("\n\nANALYSIS: "), length, F.lit(" characters\n")),
        )
        .otherwise(F.concat("text", F.lit("\n")))
    )
    pieces = F.array_sort(F.collect_list(F.struct("turn", piece.alias("p"))))
    return (
        table(spark, sf, "conversations")
        .groupBy(F.col("conv_id").alias("doc_id"))
        .agg(F.array_join(pieces["p"], "").alias("text"))
    )


@query("chunk_text")
def _(spark, sf):
    return fs.chunk_text(documents(spark, sf), "doc_id")


@query("chunk_text_small")
def _(spark, sf):
    return fs.chunk_text(documents(spark, sf), "doc_id", chunk_size=300, overlap=0)


@query("extract_qa")
def _(spark, sf):
    return fs.extract_qa(qa_documents(spark, sf), "doc_id")


@query("document_units")
def _(spark, sf):
    return fs.document_units(documents(spark, sf), "doc_id")


@query("qa_units")
def _(spark, sf):
    return fs.document_units(qa_documents(spark, sf), "doc_id")


@query("document_metadata")
def _(spark, sf):
    return fs.document_metadata(documents(spark, sf), "doc_id")


@query("qa_document_metadata")
def _(spark, sf):
    return fs.document_metadata(qa_documents(spark, sf), "doc_id")


# Vectors and search


@query("embed_text")
def _(spark, sf):
    vectors = fs.embed_text(documents(spark, sf), "text", DIMENSION)
    cells = vectors.select("doc_id", F.posexplode_outer("embedding").alias("bucket", "weight"))
    return rounded(cells.filter("weight <> 0").withColumn("weight", F.col("weight").cast("double")), "weight")


def vectors_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").alias("file_id"))


def as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").alias("query_id"), "embedding")


@query("knn")
def _(spark, sf):
    """The five nearest vectors of every vector."""
    v = vectors_of(spark, sf)
    hits = fs.nearest(v, as_queries(v), 5)
    return hits.select(
        "query_id", "rank", "vec_id", F.round(similarity(F.col("distance")), 6).alias("similarity"),
        F.round(cosine(F.col("distance")), 6).alias("cosine"),
    )


@query("knn_by_cells")
def _(spark, sf):
    """The same by the join that larger query tables take."""
    v = vectors_of(spark, sf)
    hits = fs.nearest(v, as_queries(v), 5, block_bytes=0)
    return hits.select(
        "query_id", "rank", "vec_id", F.round(similarity(F.col("distance")), 6).alias("similarity"),
        F.round(cosine(F.col("distance")), 6).alias("cosine"),
    )


@query("knn_in_file")
def _(spark, sf):
    """The same among the vectors of one file."""
    v = vectors_of(spark, sf)
    hits = fs.nearest(v, as_queries(v), 5, file_id=3)
    return rounded(hits.select("query_id", "rank", "vec_id", "distance"), "distance", digits=6)


@query("vectors_of_file")
def _(spark, sf):
    return vectors_of_file(vectors_of(spark, sf), 3).select("vec_id", "file_id")


@query("store_list")
def _(spark, sf):
    return list_stores(vectors_of(spark, sf))


@query("store_stats")
def _(spark, sf):
    return store_stats(vectors_of(spark, sf))


@query("vector_store_round_trip")
def _(spark, sf):
    """Write all vectors to a vector table, read them back."""
    path = staging_path(spark, "vectors")
    add_vectors(vectors_of(spark, sf).withColumn("file_id", F.concat(F.lit("f"), "file_id")), path, 64, buckets=8)
    back = read_vectors(spark, path)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return back.select("vec_id", "file_id", F.size("embedding").alias("dimension"), F.round(norm, 4).alias("norm"))


@query("vector_store_one_file")
def _(spark, sf):
    """One file's vectors from a table written with other than unit vectors and the default number of buckets."""
    path = staging_path(spark, "vectors")
    scaled = F.transform("embedding", lambda x: (x * 3).cast("float"))
    add_vectors(vectors_of(spark, sf).withColumn("embedding", scaled).withColumn("file_id", F.concat(F.lit("f"), "file_id")), path, 64, buckets=8)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return read_vectors(spark, path, "f3").select("vec_id", "file_id", F.round(norm, 4).alias("norm"))


@query("vector_store_reload")
def _(spark, sf):
    """The same files loaded twice, some a third time: each counts once."""
    path = staging_path(spark, "vectors")
    vectors = vectors_of(spark, sf).withColumn("file_id", F.concat(F.lit("f"), "file_id"))
    add_vectors(vectors, path, 64)
    add_vectors(vectors, path, 64, buckets=8)
    add_vectors(vectors.filter("file_id = 'f3' and vec_id % 2 = 0"), path, 64)
    return read_vectors(spark, path).select("vec_id", "file_id", F.size("embedding").alias("dimension"))


@query("vector_store_two_streams")
def _(spark, sf):
    """Two streams of text files and a batch load fill one table; then it is compacted."""
    path = staging_path(spark, "streams")
    texts = table(spark, sf, "benchmark").select("item_id", "text")
    for part in (0, 1):
        texts.filter(F.col("item_id") % 2 == part).write.partitionBy("item_id").text(f"{path}/in{part}")
        watch_documents(spark, f"{path}/in{part}", f"{path}/vectors", f"{path}/state{part}", dimension=DIMENSION).awaitTermination()
    talks = embedded_units(qa_documents(spark, sf)).withColumn("file_id", F.concat(F.lit("talk"), F.col("file_id").cast("string")))
    add_vectors(talks.drop("full_text"), f"{path}/vectors", DIMENSION)
    before = read_vectors(spark, f"{path}/vectors")
    compact(spark, f"{path}/vectors")
    after = read_vectors(spark, f"{path}/vectors")
    columns = ["chunk_idx", "chunk_type", "original_text", "question_text", "answer_text", "analysis_text"]
    both = before.select(F.lit("loads").alias("table"), *columns).unionByName(after.select(F.lit("compacted").alias("table"), *columns))
    return both


def row_queries(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("c_nationkey "), F.col("n_nationkey").cast("string"), F.lit(" c_mktsegment BUILDING"))
    return fs.embed_text(
        table(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), text.alias("q")), "q", DIMENSION
    )


def customer_units(spark: SparkSession, sf: str) -> DataFrame:
    units = fs.row_units(spread(table(spark, sf, "customer")), "customer", "c_custkey")
    return units


@query("row_units")
def _(spark, sf):
    return customer_units(spark, sf).drop("full_text")


def explained(spark: SparkSession, sf: str) -> fs.Answer:
    units = fs.embed_text(customer_units(spark, sf), "full_text", DIMENSION)
    return fs.explain_row(table(spark, sf, "customer"), units, row_queries(spark, sf), 3, "c_custkey")


@query("explain_row")
def _(spark, sf):
    return rounded(explained(spark, sf).result, "_similarity_score", digits=6)


@query("explain_row_numbers")
def _(spark, sf):
    return explained(spark, sf).numbers.withColumns(
        {
            "row_indices": joined("row_indices"),
            "similarity_scores": joined("similarity_scores", lambda x: x.cast("decimal(18,4)").cast("string")),
        }
    )


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return fs.embed_text(b, "text", DIMENSION)


def embedded_units(docs: DataFrame) -> DataFrame:
    units = fs.document_units(docs.withColumnRenamed("doc_id", "file_id"))
    return fs.embed_text(units, "full_text", DIMENSION)


def found(spark: SparkSession, sf: str) -> fs.Answer:
    return fs.document_query(embedded_units(documents(spark, sf)), text_queries(spark, sf), 3)


@query("document_query")
def _(spark, sf):
    result = found(spark, sf).result.drop("similarity_score", "question", "answer", "analysis")
    return rounded(result, "similarity", digits=6)


@query("document_query_by_cells")
def _(spark, sf):
    """The same from stored vectors, by the join that larger query tables take."""
    path = staging_path(spark, "vectors")
    units = embedded_units(documents(spark, sf)).withColumn("file_id", F.col("file_id").cast("string"))
    add_vectors(units.drop("full_text"), path, DIMENSION)
    units = read_vectors(spark, path).withColumn("file_id", F.col("file_id").cast("bigint"))
    result = fs.document_query(units, text_queries(spark, sf), 3, block_bytes=0).result
    return rounded(result.drop("similarity_score", "question", "answer", "analysis"), "similarity", digits=6)


@query("document_query_numbers")
def _(spark, sf):
    numbers = rounded(found(spark, sf).numbers, "avg_similarity", digits=6)
    return numbers.withColumn("file_ids", joined("file_ids"))


def found_qa(spark: SparkSession, sf: str) -> DataFrame:
    return fs.document_query(embedded_units(qa_documents(spark, sf)), text_queries(spark, sf), 5).result


@query("document_query_qa")
def _(spark, sf):
    return found_qa(spark, sf).select(
        "query_id", "rank", "file_id", "chunk_idx", "chunk_type", "similarity_score", "content", "question", "answer", "analysis"
    )


@query("document_context")
def _(spark, sf):
    return fs.document_context(found_qa(spark, sf))


@query("document_context_text")
def _(spark, sf):
    return fs.document_context(found(spark, sf).result).select("query_id", "context_text")


# Catalog


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return fs.table_catalog({name: table(spark, sf, name) for name in TABLES})


@query("catalog_list")
def _(spark, sf):
    return fs.list_tables(catalog(spark, sf)).withColumn("numeric_columns", joined("numeric_columns"))


@query("document_list")
def _(spark, sf):
    named = documents(spark, sf).select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.lit("txt").alias("document_type"),
        "text",
    )
    return fs.list_documents(fs.document_metadata(named))


@query("catalog_summary")
def _(spark, sf):
    return fs.catalog_summary(catalog(spark, sf), table(spark, sf, "documents"))


@query("status_counts")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"))
    return fs.status_counts(fs.status(catalog(spark, sf), docs, list_stores(vectors_of(spark, sf))))


@query("document_lookup")
def _(spark, sf):
    chunks = fs.chunk_text(table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text"))
    return find_document(chunks, 17)


@query("sample_head")
def _(spark, sf):
    return fs.sample_head(table(spark, sf, "customer"), key="c_custkey")


@query("sample_heads")
def _(spark, sf):
    """The first rows of the first two of three loaded tables."""
    tables = {name: table(spark, sf, name) for name in ("customer", "part", "nation")}
    heads = fs.samples(tables, KEYS)
    rows = [
        df.select(F.lit(name).alias("table"), F.col(KEYS[name]).alias("key"), F.to_json(F.struct(*df.columns)).alias("row"))
        for name, df in heads.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@query("load_report")
def _(spark, sf):
    """Two cleaned tables, all documents, and a file that failed."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("d"), "doc_id").alias("filename"))
    tables = {name: table(spark, sf, name) for name in ("customer", "part")}
    return fs.load_report(tables, KEYS, docs, {"broken.csv": ("csv", "no rows")})


@query("load_report_all_tables")
def _(spark, sf):
    """Shape of every table, as read."""
    report = fs.load_report({name: table(spark, sf, name) for name in TABLES}, {}, clean=False)
    return report.select("name", "file_id", "status", "rows_read", "columns_read", "type")


# Files: tables written by the sinks and read back


@query("csv_round_trip")
def _(spark, sf):
    """Write a table as CSV files, read them with type inference."""
    path = staging_path(spark, "csv-out")
    write_csv(table(spark, sf, "part"), path)
    return read_csv(spark, path, "part").rows.drop("_row_index")


@query("csv_row_positions")
def _(spark, sf):
    """Every row's position in a table that is re-read from several files under one id."""
    path = staging_path(spark, "csv-out")
    write_csv(table(spark, sf, "orders").select(*ORDER_COLUMNS).repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey"), path)
    return read_csv(spark, path, "orders").rows


@query("csv_odd_headers")
def _(spark, sf):
    """Files with a blank first line, a line break in the header, and swapped columns are one table."""
    path = staging_path(spark, "csv-out")
    part = table(spark, sf, "part")
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    forms = (
        ("\n\"key\nof part\",name\n", F.concat_ws(",", key, name)),
        ("name,\"key\nof part\"\n", F.concat_ws(",", name, key)),
        ("\"key\nof part\",name\n", F.concat_ws(",", key, F.concat(F.lit('"'), name, F.lit('"')))),
    )
    for i, (header, line) in enumerate(forms):
        lines = part.filter(F.col("p_partkey") % 3 == i).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))
        lines.select(F.concat(F.lit(header), "t")).coalesce(1).write.text(f"{path}/{i}")
    rows = read_csv(spark, [f"{path}/{i}" for i in range(3)], "part").rows
    return rows.select(F.col("`key\nof part`").alias("p_partkey"), F.col("name").alias("p_name"))


@query("json_round_trip")
def _(spark, sf):
    path = staging_path(spark, "json-out")
    write_json(table(spark, sf, "customer"), path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return spark.read.schema(schema).json(path)


@query("txt_round_trip")
def _(spark, sf):
    """Write every benchmark text to a file of its own, read the files as documents."""
    path = staging_path(spark, "txt-out")
    table(spark, sf, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    docs = read_txt(spark, path)
    return fs.document_metadata(docs).groupBy("document_type", "has_questions").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("num_characters").alias("characters"),
        F.sum(F.col("num_chunks").cast("bigint")).alias("chunks"),
    )


@F.arrow_udf(T.BinaryType())
def docx_file(texts: pa.Array) -> pa.Array:
    """Each text as a word-processing file with a paragraph for each line."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    files = []
    for text in texts.to_pylist():
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
        files.append(out.getvalue())
    return pa.array(files, pa.binary())


def write_files(rows: DataFrame, path: str, suffix: str) -> None:
    """Write each row's text (or bytes) to a file of its own, named by ``item_id``, and a line break after it.

    Tasks write the files; the driver only gives them their names.
    """
    spark = rows.sparkSession
    rows.select("item_id", F.col("text").cast("string").alias("text")).write.partitionBy("item_id").text(f"{path}/parts")
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{path}/parts")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        if folder.isDirectory():
            name = folder.getPath().getName().split("=")[1] + suffix
            part = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")][0]
            fs.rename(part, hadoop.Path(f"{path}/{name}"))
    fs.delete(root, True)


def benchmark_files(spark: SparkSession, sf: str) -> str:
    """The benchmark's texts as files, half of them TXT and half DOCX, and one broken file."""
    path = staging_path(spark, "files")
    items = table(spark, sf, "benchmark").select("item_id", "text")
    write_files(items.filter("item_id % 2 = 0"), f"{path}/texts", ".txt")
    docx = items.filter("item_id % 2 = 1").select("item_id", docx_file("text").alias("text"))
    write_files(docx, f"{path}/reports", ".docx")
    write_files(spark.range(1).select(F.lit("broken").alias("item_id"), F.lit("no archive").alias("text")), f"{path}/broken", ".docx")
    return path


def without_digest(file_id: str | Column) -> Column:
    """An id without its last part, which depends on where the files lie."""
    return F.regexp_replace(file_id, "_[0-9a-f]{16}$", "")


@query("documents_by_dispatch")
def _(spark, sf):
    """TXT and DOCX files of two folders, and what could not be read, by one scan."""
    path = benchmark_files(spark, sf)
    found = scan_documents(spark, [f"{path}/texts", f"{path}/reports", f"{path}/broken"])
    rows = found.rows.select("filename", "document_type", without_digest("file_id").alias("file_id"), "text")
    failed = found.failures.select("filename", F.substring_index("error", ":", 1).alias("error"))
    return rows.unionByName(failed, allowMissingColumns=True)


@query("documents_same_name")
def _(spark, sf):
    """Every text twice under one name in two folders: twice the documents, vectors and ids."""
    path = staging_path(spark, "files")
    items = table(spark, sf, "benchmark").select("item_id", "text")
    for folder in ("x", "y"):
        write_files(items, f"{path}/{folder}", ".txt")
    loaded = fs.ingest_documents(spark, [f"{path}/x", f"{path}/y"], f"{path}/vectors", dimension=DIMENSION)
    stores = list_stores(read_vectors(spark, f"{path}/vectors"))
    held = loaded.metadata.select("file_id", "filename", "num_chunks").join(stores, "file_id", "left")
    return held.groupBy("filename").agg(
        F.count_distinct("file_id").alias("ids"), F.sum("num_chunks").alias("chunks"), F.sum("num_vectors").alias("vectors")
    )


@query("load_files")
def _(spark, sf):
    """Tables, texts and reports in one load, with a file of each kind that fails."""
    path = benchmark_files(spark, sf)
    for name in ("customer", "part", "nation"):
        write_csv(table(spark, sf, name), f"{path}/{name}.csv")
    write_csv(table(spark, sf, "customer").limit(0), f"{path}/empty.csv")
    lines = table(spark, sf, "region").select(F.concat_ws(",", F.col("r_regionkey").cast("string"), "r_name", F.lit("more")).alias("value"))
    spark.createDataFrame([("key,name",)], "value string").unionByName(lines).coalesce(1).write.text(f"{path}/broken.csv")
    names = ["customer.csv", "part.csv", "nation.csv", "empty.csv", "broken.csv", "missing.csv", "texts", "reports", "broken"]
    report = fs.load_files(spark, [f"{path}/{n}" for n in names], f"{path}/vectors", dimension=DIMENSION).report
    stores = list_stores(read_vectors(spark, f"{path}/vectors/tables")).withColumnRenamed("num_vectors", "vectors")
    error = F.regexp_replace(F.substring_index("error", ":", 1), "^[0-9]+ ", "")
    return report.join(stores, "file_id", "left").withColumns({"file_id": without_digest("file_id"), "error": error})


@query("catalog_of_loads")
def _(spark, sf):
    """What two loads wrote down: lists of tables and documents by their real names, and the totals."""
    path = benchmark_files(spark, sf)
    for name in ("customer", "part"):
        write_csv(table(spark, sf, name), f"{path}/{name} table.csv")
    fs.load_files(spark, [f"{path}/customer table.csv", f"{path}/texts"], catalog=f"{path}/catalog")
    fs.load_files(spark, [f"{path}/part table.csv", f"{path}/customer table.csv", f"{path}/reports"], catalog=f"{path}/catalog")
    tables, docs = (read_entries(spark, f"{path}/catalog", kind) for kind in ("table", "document"))
    listed = fs.list_tables(tables).withColumn("numeric_columns", joined("numeric_columns"))
    documents = fs.list_documents(docs.withColumnRenamed("type", "document_type"))
    both = listed.unionByName(documents, allowMissingColumns=True).withColumn("file_id", without_digest("file_id"))
    return both.unionByName(fs.catalog_summary(tables, docs), allowMissingColumns=True)


@query("status_of_loads")
def _(spark, sf):
    """Every table, document, vector store and supported question after a load."""
    path = benchmark_files(spark, sf)
    write_csv(table(spark, sf, "nation"), f"{path}/nation.csv")
    fs.load_files(spark, [f"{path}/nation.csv", f"{path}/texts"], f"{path}/vectors", dimension=DIMENSION, catalog=f"{path}/catalog")
    tables, docs = (read_entries(spark, f"{path}/catalog", kind) for kind in ("table", "document"))
    held = [list_stores(read_vectors(spark, f"{path}/vectors/{kind}")) for kind in ("tables", "documents")]
    return fs.status(tables, docs, held[0].unionByName(held[1])).withColumn("id", without_digest("id"))
