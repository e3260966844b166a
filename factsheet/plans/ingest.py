"""End-to-end loading: files in, clean typed tables, units and vectors out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factsheet.functions.columns import ROW_INDEX
from factsheet.functions.session import spread, staged
from factsheet.operators.clean import clean_by_file, clean_table
from factsheet.operators.documents import CHUNK_SIZE, OVERLAP, document_metadata, document_units
from factsheet.operators.embed import DIMENSION, embed_text, row_units
from factsheet.operators.profile import description, table_fingerprint, table_profile
from factsheet.operators.quantile import SMALL
from factsheet.sources.csv import existing, read_csv, read_tables
from factsheet.sources.documents import read_documents, scan_documents
from factsheet.sources.registry import add_entries
from factsheet.sources.vectors import BUCKETS, add_vectors

Encoder = Callable[[Column], Column]


class Loaded(NamedTuple):
    """``failures`` has the files of a folder of documents that could not be read."""

    data: DataFrame
    metadata: DataFrame
    failures: DataFrame | None = None


def ingest_table(
    spark: SparkSession,
    path: str | Sequence[str],
    file_id: str,
    vectors: str | None = None,
    clean: bool = True,
    exclude: Sequence[str] = (),
    dimension: int = DIMENSION,
    buckets: int = BUCKETS,
    encoder: Encoder | None = None,
) -> Loaded:
    """Read, clean and profile a CSV table; with ``vectors`` also store a vector per row and column."""
    rows = read_csv(spark, path, file_id).rows
    table = store_table(rows, file_id, vectors, clean, exclude, dimension, buckets, encoder)
    filename = path if isinstance(path, str) else path[0]
    name = filename.rstrip("/").rsplit("/", 1)[-1]
    return Loaded(table, table_profile(table, file_id, name, skip=("file_id", ROW_INDEX)))


def store_table(rows, file_id, vectors, clean, exclude, dimension, buckets, encoder) -> DataFrame:
    """The cleaned table; its units are embedded and stored where ``vectors`` names a folder."""
    table = clean_table(rows, ROW_INDEX, (*exclude, "file_id")) if clean else rows
    if vectors is not None:
        units = row_units(table, file_id, ROW_INDEX)
        add_vectors(
            embed_text(spread(units), "full_text", dimension, encoder=encoder).drop("full_text"),
            vectors, dimension, buckets,
        )
    return table


def ingest_documents(
    spark: SparkSession,
    path: str | Sequence[str],
    vectors: str | None = None,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    dimension: int = DIMENSION,
    buckets: int = BUCKETS,
    encoder: Encoder | None = None,
    file_id: str | None = None,
) -> Loaded:
    """Read documents and describe them; with ``vectors`` also store a vector per chunk and Q&A pair.

    Files of other types are an error, broken ones are among the ``failures``. ``file_id`` names a single document.
    """
    docs, failures = read_documents(spark, path, file_id)
    if vectors is not None:
        units = document_units(spread(docs), chunk_size=chunk_size, overlap=overlap)
        add_vectors(
            embed_text(units, "full_text", dimension, encoder=encoder).drop("full_text"), vectors, dimension, buckets
        )
    metadata = document_metadata(docs, chunk_size=chunk_size, overlap=overlap).withColumn("ingestion_timestamp", F.current_timestamp())
    return Loaded(docs, metadata, failures)


class Tables(Mapping):
    """Tables by the name they have in the report; a frame is made when it is asked for."""

    def __init__(self, held: dict[str, tuple[DataFrame, str]]):
        self._held = held

    def __getitem__(self, name: str) -> DataFrame:
        frame, file_id = self._held[name]
        return frame.filter(F.col("file_id") == file_id)

    def __iter__(self):
        return iter(self._held)

    def __len__(self) -> int:
        return len(self._held)


class LoadedFiles(NamedTuple):
    """``frames`` has all tables, one frame for each set of columns; ``tables`` each by its name."""

    tables: Tables
    documents: DataFrame | None
    report: DataFrame
    frames: list[DataFrame]


REPORT = "name string, file_id string, status string, rows_read bigint, columns_read int, rows_cleaned bigint, columns_cleaned int, fingerprint string, type string, error string"


def load_files(
    spark: SparkSession,
    paths: Sequence[str],
    vectors: str | None = None,
    clean: bool = True,
    dimension: int = DIMENSION,
    encoder: Encoder | None = None,
    catalog: str | None = None,
) -> LoadedFiles:
    """Load CSV files as tables and the rest as documents; a file that fails is reported, not fatal.

    All tables are read, typed, cleaned and described together, each by its own cells, so the number of jobs
    depends on how many sets of columns there are and not on the number of files. ``vectors`` names a folder
    that receives two vector tables, ``tables`` and ``documents``; ``catalog`` one where each load writes
    down what it brought (``sources.registry``).
    """
    paths = [p.rstrip("/") for p in paths]
    bases = [p.rsplit("/", 1)[-1] for p in paths]
    # Files of the same name in several folders are told apart by their paths.
    names = {p: b if bases.count(b) == 1 else p for p, b in zip(paths, bases)}
    labels = F.broadcast(spark.createDataFrame(list(names.items()), "source string, name string"))
    csv = [p for p in paths if p.lower().endswith(".csv")]
    parts, frames, held = [spark.createDataFrame([], REPORT)], [], {}
    if csv:
        read = read_tables(spark, csv)
        frames = [f for t in read.tables for f in (clean_by_file(t) if clean else [t])]
        prints = [table_fingerprint(f, (ROW_INDEX,), "file_id").select("file_id", "fingerprint") for f in frames]
        # One row for each file.
        sources = staged(read.sources.join(labels, "source"), "sources")
        if prints:
            sources = sources.join(reduce(DataFrame.unionByName, prints), "file_id", "left")
        else:
            sources = sources.withColumn("fingerprint", F.lit(None).cast("string"))
        sources = staged(sources, "sources")
        shape = [F.col(f"num_{what}").alias(f"{what}_{when}") for when in ("read", "cleaned") for what in ("rows", "columns")]
        status = F.when(F.col("error").isNull(), "success").otherwise("error").alias("status")
        parts.append(sources.select("name", "file_id", status, *shape, "fingerprint", F.lit("csv").alias("type"), "error"))
        whole = {r["file_id"]: r for r in sources.filter("error is null").collect()}
        if catalog and frames:
            add_entries(_table_entries(frames, read.tables, sources), catalog)
        # A table of a header alone has no rows to find it by.
        held = {r["name"]: (read.tables[r["form"]], i) for i, r in whole.items()}
        for f in frames:
            held |= {whole[r["file_id"]]["name"]: (f, r["file_id"]) for r in f.select("file_id").distinct().collect()}
        if vectors and frames:
            large = [i for i, r in whole.items() if r["num_rows"] > SMALL]
            units = reduce(DataFrame.unionByName, [u for f in frames for u in _units(f, large)])
            add_vectors(embed_text(spread(units), "full_text", dimension, encoder=encoder).drop("full_text"), f"{vectors}/tables", dimension, BUCKETS)
    docs = None
    other = [p for p in paths if p not in csv]
    there = [p for p, at in existing(spark, other).items() if at]
    missing = [(names[p], None, "error", None, None, None, None, None, "document", "no such file") for p in other if p not in there]
    parts.append(spark.createDataFrame(missing, REPORT))
    if there:
        scanned = scan_documents(spark, there)
        docs = scanned.rows
        if catalog:
            described = document_metadata(docs).withColumns({"kind": F.lit("document"), "type": F.col("document_type")})
            add_entries(described.drop("document_type"), catalog)
        if vectors and not docs.isEmpty():
            units = document_units(spread(docs))
            add_vectors(embed_text(units, "full_text", dimension, encoder=encoder).drop("full_text"), f"{vectors}/documents", dimension, BUCKETS)
        good = docs.select(F.col("filename").alias("name"), "file_id", F.lit("success").alias("status"), F.md5("text").alias("fingerprint"), F.lit("document").alias("type"))
        bad = scanned.failures.select(F.col("filename").alias("name"), F.lit("error").alias("status"), F.lit("document").alias("type"), "error")
        parts += [good, bad]
    report = staged(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), "report")
    if report.filter("status = 'success'").isEmpty():
        raise ValueError(f"nothing could be loaded: {[tuple(r) for r in report.select('name', 'error').limit(10).collect()]}")
    return LoadedFiles(Tables(held), docs, report, frames)


def _table_entries(frames: Sequence[DataFrame], forms: Sequence[DataFrame], sources: DataFrame) -> DataFrame:
    """What the catalog keeps of each table; one without rows is described by its form."""
    skip = ("file_id", ROW_INDEX)
    found = [f.select("file_id").distinct().select("file_id", description(f, "", "", skip).alias("d")) for f in frames]
    for n, f in enumerate(forms):
        found.append(sources.filter((F.col("num_rows") == 0) & (F.col("form") == n)).select("file_id", description(f, "", "", skip).alias("d")))
    shape = ["num_columns", "columns", "column_types", "numeric_columns", "text_columns"]
    described = reduce(DataFrame.unionByName, found).select("file_id", *[f"d.{c}" for c in shape])
    named = sources.filter("error is null").select("file_id", "filename", "num_rows", F.lit("table").alias("kind"), F.lit("csv").alias("type"))
    return named.join(described, "file_id")


def _units(frame: DataFrame, large: Sequence[str]) -> list[DataFrame]:
    """The units of all tables of a frame; tables that are large get their medians by themselves."""
    small = frame.filter(~F.col("file_id").isin(*large)) if large else frame
    own = [row_units(t, i) for i, t in ((i, frame.filter(F.col("file_id") == i)) for i in large) if not t.isEmpty()]
    return [row_units(small, "", by_file=True), *own]
