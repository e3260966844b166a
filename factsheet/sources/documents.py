"""TXT and DOCX files as (file_id, filename, document_type, text), and the files that could not be read."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factsheet.functions.hashing import decoded, source_id
from factsheet.functions.session import staged

TXT_FILES = "*.[tT][xX][tT]"
DOCX_FILES = "*.[dD][oO][cC][xX]"
_REPLACEMENT = "�"
# Fixed value: the line before the rows of tables.
TABLES_HEADING = "\n\nTables:\n"
# Fixed value: the XML namespace of word-processing documents.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
COLUMNS = ("file_id", "filename", "document_type", "text")


class Documents(NamedTuple):
    """``rows`` has the documents, ``failures`` (path, filename, error) the files that are none."""

    rows: DataFrame
    failures: DataFrame


def _id(path: Column) -> Column:
    return source_id(path, F.md5(F.coalesce("text", F.lit("")).cast("binary")), "doc_").alias("file_id")


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def _text_files(files: DataFrame) -> DataFrame:
    """(path, filename, document_type, text, error) of whole text files."""
    raw = F.col("value")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.regexp_replace(F.make_valid_utf8(raw), _REPLACEMENT, ""))
    return files.select(
        decoded(F.col("_metadata.file_path")).alias("path"),
        decoded(F.col("_metadata.file_name")).alias("filename"),
        F.lit("txt").alias("document_type"),
        F.regexp_replace(text, "\r\n?", "\n").alias("text"),
        F.lit(None).cast("string").alias("error"),
    )


def txt_rows(files: DataFrame) -> DataFrame:
    """Documents from whole text files: UTF-8 with undecodable bytes dropped, line ends as ``\\n``."""
    return _text_files(files).withColumn("file_id", _id(F.col("path"))).select(*COLUMNS)


def _txt(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("pathGlobFilter", TXT_FILES).option("recursiveFileLookup", True).text(paths, wholetext=True)


def read_txt(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per ``.txt`` file."""
    return txt_rows(_txt(spark, _paths(path)))


def _run_text(run: ElementTree.Element) -> str:
    signs = {"t": None, "tab": "\t", "cr": "\n", "br": "\n", "noBreakHyphen": "-"}
    out = []
    for e in run:
        tag = e.tag.removeprefix(_W)
        if tag == "br" and e.get(f"{_W}type", "textWrapping") != "textWrapping":
            continue
        if tag in signs:
            out.append(e.text or "" if tag == "t" else signs[tag])
    return "".join(out)


def _paragraph(p: ElementTree.Element) -> str:
    runs = []
    for e in p:
        if e.tag == f"{_W}r":
            runs.append(e)
        elif e.tag == f"{_W}hyperlink":
            runs += e.findall(f"{_W}r")
    return "".join(map(_run_text, runs))


def _cells(row: ElementTree.Element, above: list[str]) -> list[str]:
    """The cells of a table row; a vertically merged cell repeats the cell above, a wide one itself."""
    cells: list[str] = []
    for tc in row.findall(f"{_W}tc"):
        span = tc.find(f"{_W}tcPr/{_W}gridSpan")
        merge = tc.find(f"{_W}tcPr/{_W}vMerge")
        own = "\n".join(map(_paragraph, tc.findall(f"{_W}p"))).strip()
        for _ in range(int(span.get(f"{_W}val")) if span is not None else 1):
            goes_on = merge is not None and merge.get(f"{_W}val", "continue") == "continue"
            cells.append(above[len(cells)] if goes_on and len(cells) < len(above) else own)
    return cells


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs, then the rows of all tables with their cells joined by `` | ``.

    The document is read as a stream of elements; a paragraph or table row is dropped once its text is taken.
    """
    lines: list[str] = []
    rows: list[str] = []
    above: list[str] = []
    body, table = [f"{_W}body"], [f"{_W}body", f"{_W}tbl"]
    open_tags: list[ElementTree.Element] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("word/document.xml") as xml:
        for event, e in ElementTree.iterparse(xml, ("start", "end")):
            if event == "start":
                open_tags.append(e)
                continue
            open_tags.pop()
            if len(open_tags) not in (2, 3):
                continue
            where = [x.tag for x in open_tags[1:]]
            if where == body and e.tag == f"{_W}p":
                text = _paragraph(e)
                if text.strip():
                    lines.append(text)
            elif where == table and e.tag == f"{_W}tr":
                above = _cells(e, above)
                if any(above):
                    rows.append(" | ".join(c for c in above if c))
            if where == body or where == table:
                if e.tag == f"{_W}tbl":
                    above = []
                open_tags[-1].remove(e)
    return "\n".join(lines) + (TABLES_HEADING + "\n".join(rows) if rows else "")


def _docx_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, filename, document_type, text, error) of DOCX files, unzipped and parsed in the tasks that read them."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", DOCX_FILES)
        .option("recursiveFileLookup", True)
        .load(paths)
        .select(decoded(F.col("_metadata.file_path")).alias("path"), decoded(F.col("_metadata.file_name")).alias("filename"), "content")
    )

    def parsed(content: bytes) -> tuple[str | None, str | None]:
        try:
            return docx_text(content), None
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, EOFError, OSError, NotImplementedError, RuntimeError, zlib.error) as e:
            return None, f"{type(e).__name__}: {e}".split("\n", 1)[0]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parsed(v.as_py()) for v in b.column("content")]
            columns = [b.column("path"), b.column("filename"), pa.array([t for t, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "filename", "text", "error"])

    rows = files.mapInArrow(parse, "path string, filename string, text string, error string")
    return rows.select("path", "filename", F.lit("docx").alias("document_type"), "text", "error")


def read_docx(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per ``.docx`` file that can be read."""
    rows = _docx_files(spark, _paths(path)).filter(F.col("error").isNull())
    return rows.withColumn("file_id", _id(F.col("path"))).select(*COLUMNS)


def scan_documents(spark: SparkSession, path: str | Sequence[str], file_id: str | None = None) -> Documents:
    """All documents of a folder or of given files, read once, by suffix; what fails is kept apart.

    Files of other types and files that can't be read are failures. ``file_id`` names a single document.
    """
    paths = _paths(path)
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(paths)
        .select(decoded(F.col("_metadata.file_path")).alias("path"), decoded(F.col("_metadata.file_name")).alias("filename"))
    )
    suffix = F.lower(F.regexp_extract("filename", r"(\.[^./]*)$", 1))
    # Only the listing is looked at here, not the contents.
    other = listing.filter(~suffix.isin(".txt", ".docx")).select(
        "path", "filename", F.lit(None).cast("string").alias("document_type"), F.lit(None).cast("string").alias("text"),
        F.concat(F.lit("unsupported file type: "), suffix).alias("error"),
    )
    # Written once to the shared folder, so that files are parsed a single time.
    found = staged(_text_files(_txt(spark, paths)).unionByName(_docx_files(spark, paths)).unionByName(other), "documents")
    good = found.filter(F.col("error").isNull())
    rows = good.withColumn("file_id", F.lit(file_id) if file_id is not None else _id(F.col("path"))).select(*COLUMNS)
    if not rows.groupBy("file_id").count().filter("count > 1").isEmpty():
        raise ValueError("two documents have one id" if file_id is None else f"{file_id} would name more than one document")
    return Documents(rows, found.filter(F.col("error").isNotNull()).select("path", "filename", "error"))


def read_documents(spark: SparkSession, path: str | Sequence[str], file_id: str | None = None) -> Documents:
    """``scan_documents``, where files of other types and a folder without documents are an error."""
    found = scan_documents(spark, path, file_id)
    unsupported = found.failures.filter(F.col("error").startswith("unsupported")).select(F.max("error")).first()[0]
    if unsupported:
        raise ValueError(unsupported)
    if found.rows.isEmpty() and found.failures.isEmpty():
        raise ValueError(f"no documents in {path}")
    return found


def find_document(documents: DataFrame, file_id: str) -> DataFrame:
    """Text, chunks or metadata rows of one document; works on any table with a ``file_id``."""
    return documents.filter(F.col("file_id") == file_id)
