"""Helpers of the document operators: reading, words, batches and durable cuts."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factsheet.functions.session import shared_folder

#: What separates the words of a text in the shingle operators: all but letters and digits.
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Characters that one numpy step handles; longer batches are cut. A step takes some hundred bytes for each.
STEP_CHARS = 1 << 18
#: Rows of a batch whose texts are Python strings at a time.
STEP_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that all executors share."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that its lineage ends at durable files."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def picked(docs: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(column, new name) pairs only: other columns, whatever their names, don't get in the way."""
    return docs.select(*[F.col(f"`{old}`").alias(new) for old, new in pairs])


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null gives an empty array."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of each word, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def once(key, make: Callable):
    """What ``make`` gives, made once for each Python process and kept for its later tasks."""
    kept = sys.__dict__.setdefault("_factsheet_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def by_rows(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a function to each Arrow batch of a frame, in steps of a few rows."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, STEP_ROWS):
                yield from function(batch.slice(start, STEP_ROWS))

    return df.mapInArrow(run, schema)


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and n + 1 offsets of a list column of numbers."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def grouped(rows: DataFrame, function, schema: str) -> DataFrame:
    """Apply a function to all rows of each (k, i, j) as one Arrow table."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            k, i, j = (table.column(c).to_numpy() for c in range(3))
            starts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if b - a > 1:
                    yield from function(table.slice(a, b - a).combine_chunks())
            rest = table.slice(int(starts[-1])).combine_chunks()
        if rest is not None and len(rest) > 1:
            yield from function(rest)

    return rows.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(run, schema)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether a stored frame has at most so many rows; the check that stands before each broadcast."""
    return df.count() <= rows


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = 1_000_000) -> DataFrame:
    """Join with a narrow stored table: broadcast up to a number of rows, shuffled beyond it."""
    return left.join(F.broadcast(right) if is_small(right, rows) else right, on, how)
