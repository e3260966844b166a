"""Table profile, column summaries, row texts and table fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsheet.functions.columns import col, measure, split_columns, sql_text, texts, value
from factsheet.functions.hashing import fingerprint, row_digest
from factsheet.functions.text import fixed_text, printed
from factsheet.operators.quantile import SMALL, figures

#: Texts up to this length are counted as they are, longer ones by digests.
SHORT = 64
# Names a data-frame user knows for the types a CSV can hold.
TYPE_NAMES = {
    "long": "int64",
    "integer": "int32",
    "short": "int16",
    "byte": "int8",
    "double": "float64",
    "float": "float32",
    "boolean": "bool",
    "timestamp": "datetime64[ns]",
    "timestamp_ntz": "datetime64[ns]",
}


def description(df: DataFrame, file_id: str, filename: str, skip: Sequence[str] = ()) -> Column:
    """What is known of a table without reading it: a constant struct."""
    fields = [f for f in df.schema.fields if f.name not in skip]
    numeric, text = split_columns(df, skip)
    types = ", ".join(
        f"{sql_text(f.name)}, {sql_text(TYPE_NAMES.get(f.dataType.typeName(), 'object'))}" for f in fields
    )
    return F.struct(
        F.lit(file_id).alias("file_id"),
        F.lit(filename).alias("filename"),
        F.lit(len(fields)).alias("num_columns"),
        texts([f.name for f in fields]).alias("columns"),
        F.expr(f"cast(map({types}) as map<string,string>)").alias("column_types"),
        texts(numeric).alias("numeric_columns"),
        texts(text).alias("text_columns"),
    )


def profiles(tables: Sequence[tuple[DataFrame, str, str]], skip: Sequence[str] = ()) -> DataFrame:
    """One row per (table, file id, filename): its size, its columns with their types, the numeric/text split.

    The rows of all tables are counted in one aggregation.
    """
    spark = tables[0][0].sparkSession
    known = spark.range(1).select(F.inline(F.array(*[description(*t, skip) for t in tables])))
    marks = [df.select(F.lit(file_id).alias("file_id")) for df, file_id, _ in tables]
    counts = reduce(DataFrame.unionByName, marks).groupBy("file_id").agg(F.count(F.lit(1)).alias("num_rows"))
    facts = [c for c in known.columns if c != "file_id"]
    return (
        known.unionByName(counts, allowMissingColumns=True)
        .groupBy("file_id")
        .agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in facts],
            F.coalesce(F.max("num_rows"), F.lit(0)).alias("num_rows"),
            F.current_timestamp().alias("ingestion_timestamp"),
        )
        .select(
            "file_id", "filename", "num_rows", "num_columns", "columns", "column_types", "numeric_columns",
            "text_columns", "ingestion_timestamp",
        )
    )


def table_profile(df: DataFrame, file_id: str, filename: str, skip: Sequence[str] = ()) -> DataFrame:
    return profiles([(df, file_id, filename)], skip)


def numeric_figures(df: DataFrame, names: Sequence[str], small: int = SMALL) -> DataFrame:
    """One row with lo, hi (as the column is typed), mean and exact median (mid) of each column, from two scans."""
    wanted = [
        f.alias(f"{label}{i}")
        for i, c in enumerate(names)
        for label, f in (("lo", F.min(value(df, c))), ("hi", F.max(value(df, c))), ("mean", F.avg(measure(df, c)).cast("double")))
    ]
    facts, middle = figures(df, names, wanted, small)
    types = df.agg(*wanted).schema
    kinds = T.StructType([*types.fields, *[T.StructField(f"mid{i}", T.DoubleType()) for i in range(len(names))]])
    return df.sparkSession.createDataFrame([(*facts[: len(wanted)], *[middle[c] for c in names])], kinds)


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, small: int = SMALL) -> DataFrame:
    """(column, min, max, mean, median) with exact medians, all columns together."""
    names = list(columns if columns is not None else split_columns(df)[0])

    def double(name: str, i: int) -> Column:
        boolean = isinstance(df.schema[names[i]].dataType, T.BooleanType)
        return (F.col(name).cast("int") if boolean else F.col(name)).cast("double")

    rows = [
        F.struct(
            F.lit(c).alias("column"),
            double(f"lo{i}", i).alias("min"),
            double(f"hi{i}", i).alias("max"),
            F.col(f"mean{i}").alias("mean"),
            F.col(f"mid{i}").alias("median"),
        )
        for i, c in enumerate(names)
    ]
    return numeric_figures(df, names, small).select(F.inline(F.array(*rows)))


def figures_by(df: DataFrame, names: Sequence[str], by: str) -> DataFrame:
    """``numeric_figures`` of many small tables at once, told apart by ``by``; each median is found in one task."""
    wanted = [
        f.alias(f"{label}{i}")
        for i, c in enumerate(names)
        for label, f in (("lo", F.min(value(df, c))), ("hi", F.max(value(df, c))), ("mean", F.avg(measure(df, c)).cast("double")), ("mid", F.median(measure(df, c).cast("double"))))
    ]
    return df.groupBy(by).agg(*wanted)


def categorical_summary(
    df: DataFrame, columns: Sequence[str] | None = None, key: str | None = None, top: int = 3, by: str | None = None
) -> DataFrame:
    """(column, unique_values, top_values): distinct count without nulls, most frequent values.

    With ``by`` the same for each of many tables that the column of this name tells apart.

    All columns are counted together in long form, so each value is counted map-side and a
    value held by many rows crosses the shuffle once per task. Texts of more than ``SHORT`` characters
    are counted by 128 bits of digest; only the most frequent of them are fetched by their digests.
    Equal counts are ordered by first appearance when ``key`` is given, else by value.
    """
    names = list(columns if columns is not None else split_columns(df)[1])
    of = ["b"] if by else []

    def cell(i: int, c: str) -> Column:
        return F.struct(F.lit(i).alias("i"), printed(value(df, c), df.schema[c].dataType).alias("v"))

    cells = F.explode(F.array(*[cell(i, c) for i, c in enumerate(names)])).alias("e")
    others = [col(name).alias(as_) for name, as_ in ((key, "k"), (by, "b")) if name]
    is_long = F.length("e.v") > SHORT
    long = df.select(cells, *others).filter("e.v is not null").select(
        "e.*", *["k"] * bool(key), *of,
        F.when(~is_long, F.col("e.v")).alias("short"),
        F.when(is_long, F.xxhash64(F.lit(1), "e.v")).alias("d1"),
        F.when(is_long, F.xxhash64(F.lit(2), "e.v")).alias("d2"),
    )
    digest = [*of, "i", "d1", "d2"]
    # Without a key the starts of long texts order them, and their whole texts those of equal starts.
    order = F.min("k") if key else F.min(F.substring("v", 1, SHORT))
    counts = long.groupBy(*digest, "short").agg(F.count(F.lit(1)).alias("n"), order.alias("seen"))
    first = W.partitionBy(*of, "i").orderBy(F.desc("n"), "seen")
    best = counts.withColumn("r", F.rank().over(first)).filter(F.col("r") <= top).select(*digest, "short", "n", "seen")
    # The most frequent values: a few for each column, but for long texts that begin alike.
    digests = best.filter("d1 is not null").select(*digest)
    fetched = long.filter("d1 is not null").join(digests, digest, "left_semi").groupBy(*digest).agg(F.min("v").alias("v"))
    whole = best.filter("d1 is not null").join(fetched, digest).select(*of, "i", "v", "n", "seen")
    listed = best.filter("short is not null").select(*of, "i", F.col("short").alias("v"), "n", "seen").unionByName(whole)
    last = W.partitionBy(*of, "i").orderBy(F.desc("n"), "seen", "v")
    listed = listed.withColumn("r", F.row_number().over(last)).filter(F.col("r") <= top).select(*of, "i", "v", "r", F.lit(0).cast("bigint").alias("distinct"))
    # Reads every column of ``counts``, so that both uses share one exchange.
    counted = (F.col("n") > 0) | F.col("seen").isNull() | F.col("short").isNull() | F.col("d1").isNull() | F.col("d2").isNull()
    sizes = counts.groupBy(*of, "i").agg(F.count_if(counted).alias("distinct"))
    every = (df.select(col(by).alias("b")).distinct() if by else df.sparkSession.range(1)).select(*of, F.posexplode(texts(names)).alias("i", "column"))
    found = (
        listed.unionByName(sizes, allowMissingColumns=True)
        .unionByName(every, allowMissingColumns=True)
        .groupBy(*of, "i")
        .agg(
            F.max("column").alias("column"),
            F.coalesce(F.max("distinct"), F.lit(0)).alias("unique_values"),
            F.array_sort(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "v"))))["v"].alias("top_values"),
        )
        .drop("i")
    )
    return found.withColumnRenamed("b", by) if by else found


def column_summaries(
    df: DataFrame, columns: Sequence[str] | None = None, key: str | None = None, small: int = SMALL, by: str | None = None
) -> DataFrame:
    """(column_name, summary): one descriptive sentence per column of the table.

    With ``by`` the same for each of many small tables that the column of this name tells apart.
    """
    wanted = list(columns if columns is not None else df.columns)
    of = [col(by)] if by else []
    numeric, text = ([c for c in names if c in wanted] for names in split_columns(df))
    parts = []
    if numeric:
        found = figures_by(df, numeric, by) if by else numeric_figures(df, numeric, small)
        nan = F.lit("nan")
        # The wording of both sentences.
        sentences = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.concat(
                    F.lit(f"Column {c}: numeric. Min: "),
                    F.coalesce(printed(F.col(f"lo{i}"), df.schema[c].dataType), nan),
                    F.lit(", Max: "),
                    F.coalesce(printed(F.col(f"hi{i}"), df.schema[c].dataType), nan),
                    F.lit(", Mean: "),
                    F.when(F.col(f"mean{i}").isNotNull(), fixed_text(F.col(f"mean{i}"), 2)).otherwise(nan),
                    F.lit(", Median: "),
                    F.coalesce(printed(F.col(f"mid{i}"), T.DoubleType()), nan),
                ).alias("summary"),
            )
            for i, c in enumerate(numeric)
        ]
        parts.append(found.select(*of, F.inline(F.array(*sentences))))
    if text:
        parts.append(
            categorical_summary(df, text, key, by=by).select(
                *of,
                F.col("column").alias("column_name"),
                F.concat(
                    F.lit("Column "),
                    F.col("column"),
                    F.lit(": text/categorical. Unique values: "),
                    F.col("unique_values").cast("string"),
                    F.lit(". Top values: "),
                    F.array_join("top_values", ", "),
                ).alias("summary"),
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def table_fingerprint(df: DataFrame, skip: Sequence[str] = (), by: str | None = None) -> DataFrame:
    """One row (num_rows, digest_sum, fingerprint) that says whether two tables hold the same rows.

    With ``by`` one row for each of the tables that the column of this name tells apart; it isn't a cell itself.
    """
    names = [c for c in df.columns if c not in skip and c != by]
    of = [col(by)] if by else []
    return df.groupBy(*of).agg(
        F.count(F.lit(1)).alias("num_rows"), F.coalesce(F.sum(row_digest(df, names)), F.lit(0)).alias("digest_sum")
    ).select(
        *of,
        "num_rows",
        F.col("digest_sum").cast("decimal(38,0)").cast("string").alias("digest_sum"),
        fingerprint(names, F.col("num_rows"), F.col("digest_sum")).alias("fingerprint"),
    )
