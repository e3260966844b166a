"""CSV tables: header, missing-value tokens, type inference and row positions.

A read costs one pass over the text to stage it as parquet in the shared folder, one
aggregate over the staged strings to infer all types at once, and no shuffle. The staged
copy also fixes the row positions: they come from physical columns, so a task that is run
again after the loss of an executor cannot number its rows differently.

Files with line breaks inside quotes are read in splits, too (``sources.records``).
"""

from __future__ import annotations

import csv as _csv
import io
import json
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsheet.functions.columns import ROW_INDEX
from factsheet.functions.hashing import decoded, source_id
from factsheet.functions.session import staged, staging_path
from factsheet.sources.records import AT, FILE, NAME, RECORD, SPLIT, lines, records

# Cells that mean "missing".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

INTEGER = r"^\s*[+-]?[0-9]+\s*$"
FLOATING = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)\s*$"
BOOLEAN = ("True", "TRUE", "true", "False", "FALSE", "false")

# Row offsets are broadcast only up to this many file splits, else they are joined by shuffle.
BROADCAST_SPLITS = 500_000

_POSITION, _EXTRA, _ORDER, _WIDTH, _FORM = "_position", "_extra", "_order", "_width", "_form"


class CsvTable(NamedTuple):
    """``rows`` has the typed columns plus ``file_id`` and ``_row_index``; ``files`` one row per file."""

    rows: DataFrame
    files: DataFrame


def _fields(head: str) -> list[str]:
    """The raw fields of the first record of a text; it may have line breaks inside quotes."""
    return next((r for r in _csv.reader(io.StringIO(head.lstrip("\ufeff"))) if r), [])


def header_names(line: str) -> list[str]:
    """Column names of a header; repeated names get .1, .2 and empty ones ``Unnamed: i``.

    Names count as repeated whatever their case, as Spark sees them, and so do names that would
    hide the columns which a read adds.
    """
    names, seen = [], {"file_id", ROW_INDEX}
    for i, raw in enumerate(_fields(line)):
        base = raw if raw else f"Unnamed: {i}"
        name, n = base, 0
        while name.lower() in seen:
            n += 1
            name = f"{base}.{n}"
        seen.add(name.lower())
        names.append(name)
    return names


@F.arrow_udf(T.StringType())
def _names(heads: pa.Array) -> pa.Array:
    return pa.array([json.dumps(header_names(h)) for h in heads.to_pylist()], pa.string())


def _heads(spark: SparkSession, paths: Sequence[str], multi_line: bool | None) -> DataFrame:
    """Per file: its first line that isn't blank, and whether a line break inside quotes is possible.

    It is when a line has an odd number of quotes, or a quote amid other characters, which opens nothing.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    doubtful = F.col("value").contains('"') & ((quotes % 2 == 1) | F.col("value").rlike('[^,"]"[^,"]'))
    # Ids in a task grow with its lines, and a task reads a file's splits in order.
    at = F.struct(F.col(SPLIT), F.monotonically_increasing_id()).alias("at")
    found = lines(spark, paths).filter(F.trim("value") != "").select(FILE, at, "value", doubtful.alias("odd"))
    heads = found.groupBy(FILE).agg(F.min_by("value", "at").alias("head"), F.max("odd").alias("odd"))
    if multi_line is not None:
        heads = heads.withColumn("odd", F.lit(multi_line))
    return staged(heads, "heads")


def _strings(width: int) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)] + [T.StructField(_EXTRA, T.StringType())])


def _read_strings(spark: SparkSession, paths: Sequence[str], width: int) -> DataFrame:
    """The cells of files whose records are lines."""
    reader = spark.read.schema(_strings(width)).option("header", True).option("escape", '"').option("enforceSchema", True)
    return reader.csv(list(paths)).select(
        "*",
        decoded(F.col("_metadata.file_path")).alias(FILE),
        decoded(F.col("_metadata.file_name")).alias(NAME),
        F.col("_metadata.file_block_start").alias(SPLIT),
        F.monotonically_increasing_id().alias(_POSITION),
    )


def _read_records(found: DataFrame, heads: DataFrame, width: int) -> DataFrame:
    """The cells of records with line breaks, without the records that are headers."""
    first = heads.select(F.col(FILE).alias("_f"), F.col("first").alias("_first"))
    rows = found.join(_fitting(first), (F.col(FILE) == F.col("_f")) & (F.struct(SPLIT, AT) == F.col("_first")), "left_anti")
    schema = ", ".join(f"{f.name} string" for f in _strings(width))
    cells = F.from_csv(F.col(RECORD), schema, {"escape": '"'}).alias("c")
    return rows.select(cells, FILE, NAME, SPLIT, F.col(AT).alias(_POSITION)).select("c.*", FILE, NAME, SPLIT, _POSITION)


def _fitting(files: DataFrame) -> DataFrame:
    """A table of one row for each file, to be broadcast up to a checked number of them."""
    return F.broadcast(files) if files.count() <= BROADCAST_SPLITS else files


def _labelled(df: DataFrame, width: int, order: Sequence[int] | None) -> DataFrame:
    """Cells c0, c1, ... in the table's order; ``order``, or else the column of that name, says where a file has them."""
    extra = F.col(_EXTRA).isNotNull()
    found = F.array(*[f"c{i}" for i in range(width)])
    if _WIDTH in df.columns:
        extra = extra | F.exists(F.slice(found, F.col(_WIDTH) + 1, F.lit(width) - F.col(_WIDTH)), lambda x: x.isNotNull())
    moved = [F.get(found, F.get(F.col(_ORDER), i)) if order is None else F.col(f"c{order[i]}") for i in range(width)]
    cells = [F.when(~c.isin(*NA_TOKENS), c).alias(f"c{i}") for i, c in enumerate(moved)]
    return df.select(*cells, extra.alias(_EXTRA), FILE, NAME, SPLIT, _POSITION, *([_FORM] if _FORM in df.columns else []))


def _checks(width: int) -> list[Column]:
    """How many cells of each column are filled, and how many read as a type."""
    checks = []
    for i in range(width):
        c = F.col(f"c{i}")
        checks += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c.rlike(INTEGER) & F.trim(c).try_cast("bigint").isNotNull()).alias(f"int{i}"),
            F.count_if(c.rlike(FLOATING)).alias(f"float{i}"),
            F.count_if(c.isin(*BOOLEAN)).alias(f"bool{i}"),
        ]
    return [F.count(F.lit(1)).alias("rows"), F.count_if(_EXTRA).alias("long"), *checks]


def _type(i: int) -> Column:
    """The type of a column, from the row of its checks."""
    filled, full = F.col(f"n{i}"), F.col(f"n{i}") == F.col("rows")
    return (
        F.when((F.col(f"int{i}") == filled) & (filled > 0) & full, "bigint")
        .when(F.col(f"float{i}") == filled, "double")
        .when((F.col(f"bool{i}") == filled) & full, "boolean")
        .otherwise("string")
    )


def _too_long(rows: int, width: int) -> str:
    return f"{rows} rows have more fields than the header's {width}"


def _inferred(cells: DataFrame, names: Sequence[str]) -> dict[str, str]:
    width = len(names)
    row = cells.agg(*_checks(width)).select("long", F.array(*[_type(i) for i in range(width)]).alias("types")).first()
    if row["long"]:
        raise ValueError(_too_long(row["long"], width))
    return dict(zip(names, row["types"]))


def _typed(i: int, name: str, dtype: str) -> Column:
    c = F.col(f"c{i}")
    return c.alias(name) if dtype == "string" else F.trim(c).cast(dtype).alias(name)


def _splits(rows: DataFrame, width: int, file_id: str | None) -> DataFrame:
    """Per file split: its file, the position of its first row in the task, rows, and a digest of the rows."""
    digest = F.xxhash64(*[f"c{i}" for i in range(width)]).cast("decimal(20,0)") if file_id is None else F.lit(0).cast("decimal(20,0)")
    found = rows.groupBy(FILE, NAME, SPLIT).agg(F.min(_POSITION).alias("_base"), F.count(F.lit(1)).alias("_n"), F.sum(digest).alias("_digest"))
    return staged(found, "splits")


def _files(splits: DataFrame, file_id: str | None) -> DataFrame:
    """Per file: its id, by path and content unless one is given, and its rows."""
    files = splits.groupBy(FILE, NAME).agg(F.sum("_n").alias("num_rows"), F.sum("_digest").alias("_digest"))
    content = F.concat_ws("/", F.col("num_rows").cast("string"), F.col("_digest").cast("string"))
    given = F.lit(file_id) if file_id is not None else source_id(F.col(FILE), content)
    files = files.select(FILE, NAME, given.alias("file_id"), "num_rows")
    if file_id is None and not files.groupBy("file_id").count().filter("count > 1").isEmpty():
        raise ValueError("two files got one id; read them under ids of your own")
    return files


def _offsets(splits: DataFrame, files: DataFrame, across: bool) -> DataFrame:
    """Per file split: its file's id, and the position of its first row in the task and in the table.

    ``across`` numbers the rows of all files together, in the order of their paths: files under one id.
    """
    order = W.orderBy(FILE, SPLIT) if across else W.partitionBy(FILE).orderBy(SPLIT)
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return splits.join(files.select(FILE, "file_id"), FILE).select(FILE, SPLIT, "file_id", "_base", before.alias("_before"))


def _forms(heads: DataFrame) -> tuple[list[str], DataFrame | None]:
    """The table's column names, and per file where it has them; None if all files agree.

    Only distinct headers reach the driver.
    """
    kinds = [json.loads(r["names"]) for r in heads.groupBy("names").agg(F.min(FILE).alias("f")).orderBy("f").collect()]
    names = kinds[0]
    for other in kinds:
        if sorted(other) != sorted(names):
            raise ValueError(f"files have different headers: {names} and {other}")
    if len(kinds) == 1:
        return names, None
    orders = [(json.dumps(k), [k.index(n) for n in names]) for k in kinds]
    table = heads.sparkSession.createDataFrame(orders, f"names string, {_ORDER} array<int>")
    return names, heads.select(FILE, "names").join(F.broadcast(table), "names").select(FILE, _ORDER)


def _headed(spark: SparkSession, paths: Sequence[str], multi_line: bool | None) -> tuple[DataFrame, DataFrame | None]:
    """Per file: its column names as JSON, and the place of its header if its records go over lines; those records."""
    heads = _heads(spark, paths, multi_line)
    has = {r["odd"] for r in heads.select("odd").distinct().collect()}
    plain = heads.filter("not odd").select(FILE, "head", F.lit(None).cast(f"struct<{SPLIT}: bigint, {AT}: bigint>").alias("first"))
    found = None
    if True in has:
        found = records(spark, paths, None if False not in has else heads.filter("odd").select(FILE))
        at = F.struct(SPLIT, AT)
        plain = plain.unionByName(found.groupBy(FILE).agg(F.min_by(RECORD, at).alias("head"), F.min(at).alias("first")))
    return staged(plain.withColumn("names", _names("head")).drop("head"), "heads"), found


def _stage_cells(spark: SparkSession, paths: Sequence[str], heads: DataFrame, found: DataFrame | None, orders: DataFrame | None, width: int) -> DataFrame:
    """The cells of all files in the order of their table, with their positions.

    ``orders`` has for each file where it has the table's columns (None: all as they are) and may have
    ``_width``, the columns of its table, and ``_form``, which parts the stored cells.
    """
    folder = staging_path(spark, "csv")
    kinds = {r["plain"] for r in heads.select(F.col("first").isNull().alias("plain")).distinct().collect()}
    parts = []
    if True in kinds:
        rows = _read_strings(spark, paths, width)
        if False in kinds:
            rows = rows.join(_fitting(heads.filter("first is null").select(FILE)), FILE, "left_semi")
        parts.append(rows)
    if False in kinds:
        parts.append(_read_records(found, heads.filter("first is not null"), width))
    # Positions are numbered per scan, so each way of reading is staged on its own.
    for i, rows in enumerate(parts):
        rows = rows if orders is None else rows.join(_fitting(orders), FILE)
        cells = _labelled(rows, width, range(width) if orders is None else None)
        (cells.write.partitionBy(_FORM) if _FORM in cells.columns else cells.write).parquet(f"{folder}/part={i}")
    kinds = [T.StructField(f.name, f.dataType) for f in cells.schema if f.name != _FORM]
    schema = T.StructType(kinds + ([T.StructField(_FORM, T.IntegerType())] if _FORM in cells.columns else []))
    return spark.read.option("basePath", folder).schema(schema).parquet(*[f"{folder}/part={i}" for i in range(len(parts))])


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    file_id: str | None = None,
    multi_line: bool | None = None,
) -> CsvTable:
    """Read CSV files of one table; their headers must have the same names, in any order.

    Integers become bigint (double when the column has gaps), other numbers double,
    True/False columns without gaps boolean; dates stay text. Rows with fewer fields are filled with
    nulls; rows with more are an error. ``multi_line`` of None finds the files that may have line breaks
    inside quotes; what their splits start in is worked out first, so that many tasks read one file. With a
    given ``file_id`` the rows of all files are numbered together, else each file on its own.
    """
    paths = [path] if isinstance(path, str) else list(path)
    heads, found = _headed(spark, paths, multi_line)
    if heads.isEmpty():
        raise ValueError(f"no rows in {paths}")
    names, orders = _forms(heads)
    width = len(names)

    cells = _stage_cells(spark, paths, heads, found, orders, width)

    types = _inferred(cells, names)
    splits = _splits(cells, width, file_id)
    files = _files(splits, file_id)
    rows = cells.join(_fitting(_offsets(splits, files, file_id is not None)), [FILE, SPLIT]).select(
        "file_id",
        (F.col(_POSITION) - F.col("_base") + F.col("_before")).alias(ROW_INDEX),
        *[_typed(i, n, types[n]) for i, n in enumerate(names)],
    )
    return CsvTable(rows, files.select("file_id", F.col(NAME).alias("filename"), "num_rows", F.lit(width).alias("num_columns")))


class CsvTables(NamedTuple):
    """``tables`` has one frame for each form of a table (its columns and their types), with all tables of that form.

    ``sources`` has a row for each path that was asked for: source, filename, file_id, num_rows, num_columns,
    form (the place of its frame in ``tables``), error.
    """

    tables: list[DataFrame]
    sources: DataFrame


def _qualified(path: Column) -> Column:
    """A file's address with one spelling of the slashes after its scheme."""
    return F.regexp_replace(path, r"^([A-Za-z0-9+.-]+):/+", "$1:/")


def existing(spark: SparkSession, sources: Sequence[str]) -> dict[str, str | None]:
    """The address of each path, None if there is nothing."""
    found = {}
    for s in sources:
        path = spark._jvm.org.apache.hadoop.fs.Path(s)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found[s] = fs.makeQualified(path).toString() if fs.exists(path) else None
    return found


def read_tables(spark: SparkSession, sources: Sequence[str], multi_line: bool | None = None) -> CsvTables:
    """Read many CSV tables at once; each path is a file or a folder of files, and a table of its own.

    The number of jobs depends on the forms of tables, not on their number: headers of all files come from one
    scan, cells from one more, types of all tables from one aggregation over them. A path that can't be read
    is a row with an error. Types are found for each table by itself, as ``read_csv`` does.
    """
    at = existing(spark, sources)
    asked = spark.createDataFrame([(s, a, None if a else "no such file") for s, a in at.items()], "source string, address string, missing string")
    asked = asked.select("source", "missing", _qualified(F.col("address")).alias("_source"))
    paths = [s for s, a in at.items() if a]
    none = asked.select(
        "source", F.regexp_extract("source", r"([^/]*)/*$", 1).alias("filename"), F.lit(None).cast("string").alias("file_id"),
        F.lit(None).cast("bigint").alias("num_rows"), F.lit(None).cast("int").alias("num_columns"), F.lit(None).cast("int").alias("form"), F.coalesce("missing", F.lit("no rows")).alias("error"),
    )
    heads, found = _headed(spark, paths, multi_line) if paths else (None, None)
    if heads is None or heads.isEmpty():
        return CsvTables([], none)

    # One row for each path that was asked for.
    few = _fitting(asked.filter("missing is null").select("_source").distinct())
    own, parent = _qualified(F.col(FILE)), F.regexp_replace(_qualified(F.col(FILE)), "/[^/]*$", "")
    of = heads.withColumns({"_own": own, "_parent": parent})
    of = of.join(few.withColumnRenamed("_source", "_s1"), F.col("_own") == F.col("_s1"), "left").join(few.withColumnRenamed("_source", "_s2"), F.col("_parent") == F.col("_s2"), "left")
    listed = F.from_json("names", "array<string>")
    files = of.select(FILE, F.coalesce("_s1", "_s2").alias("_source"), listed.alias("own"))
    first = files.groupBy("_source").agg(F.min_by("own", FILE).alias("names"))
    place = F.transform("names", lambda n: (F.array_position("own", n) - 1).cast("int"))
    files = files.join(first, "_source").select(FILE, "_source", "names", place.alias(_ORDER), F.size("names").alias(_WIDTH), (F.sort_array("own") == F.sort_array("names")).alias("same"))
    files = staged(files, "files")

    # Headers that differ; one folder of stored cells for each.
    forms = sorted(r["names"] for r in files.select("names").distinct().collect())
    width = max(map(len, forms))
    numbered = F.broadcast(spark.createDataFrame(list(zip(forms, range(len(forms)))), f"names array<string>, {_FORM} int"))
    files = files.join(numbered, "names")
    cells = _stage_cells(spark, paths, heads, found, files.select(FILE, _ORDER, _WIDTH, _FORM), width)

    splits = _splits(cells, width, None)
    known = _fitting(files.select(FILE, "_source"))
    checked = cells.join(known, FILE).groupBy("_source").agg(*_checks(width))
    content = splits.join(known, FILE).groupBy("_source").agg(F.sum("_digest").alias("_digest"))
    kinds = F.slice(F.array(*[_type(i) for i in range(width)]), 1, F.size("names"))
    shapes = files.groupBy("_source", "names", _FORM).agg(F.every("same").alias("same")).join(checked, "_source", "left").join(content, "_source", "left")
    shapes = shapes.fillna(0, [c for c in checked.columns if c != "_source"])
    wrong = F.when(~F.col("same"), "files have different headers").when(
        F.col("long") > 0, F.format_string(_too_long("%d", "%d"), F.col("long"), F.size("names"))
    )
    digest = F.concat_ws("/", F.to_json("names"), F.col("rows").cast("string"), F.col("_digest").cast("string"))
    shapes = staged(shapes.select("_source", "names", _FORM, "rows", kinds.alias("types"), wrong.alias("wrong"), source_id(F.col("_source"), digest).alias("file_id")), "shapes")
    if not shapes.groupBy("file_id").count().filter("count > 1").isEmpty():
        raise ValueError("two files got one id; read them under ids of your own")

    good = shapes.filter("wrong is null")
    # Rows of a table are numbered through its files.
    before = W.partitionBy("_source").orderBy(FILE, SPLIT).rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.join(known, FILE).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    tables = []
    kinds = sorted(tuple(r) for r in good.select(_FORM, "names", "types").distinct().collect())
    for form, names, types in kinds:
        here = good.filter((F.col(_FORM) == form) & (F.col("types") == F.array(*map(F.lit, types)))).select("_source", "file_id")
        placed = offsets.join(here, "_source").select(FILE, SPLIT, "file_id", "_base", "_before")
        rows = cells.filter(F.col(_FORM) == form).join(_fitting(placed), [FILE, SPLIT])
        index = (F.col(_POSITION) - F.col("_base") + F.col("_before")).alias(ROW_INDEX)
        tables.append(rows.select("file_id", index, *[_typed(i, n, t) for i, (n, t) in enumerate(zip(names, types))]))
    numbered = spark.createDataFrame([(form, types, n) for n, (form, _, types) in enumerate(kinds)], f"{_FORM} int, types array<string>, n int")
    read = shapes.join(F.broadcast(numbered), [_FORM, "types"], "left")
    read = read.select("_source", F.col("file_id").alias("id"), "rows", F.size("names").alias("width"), "n", "wrong")
    report = none.join(asked.select("source", "_source"), "source").join(read, "_source", "left")
    known_rows = F.col("wrong").isNull() & F.col("id").isNotNull()
    return CsvTables(
        tables,
        report.select(
            "source", "filename", F.when(known_rows, F.col("id")).alias("file_id"), F.when(known_rows, F.col("rows")).alias("num_rows"),
            F.when(known_rows, F.col("width")).alias("num_columns"), F.when(known_rows, F.col("n")).alias("form"), F.when(~known_rows, F.coalesce("wrong", "error")).alias("error"),
        ),
    )
