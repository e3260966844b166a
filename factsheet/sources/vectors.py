"""The vector table: committed loads, each parquet in hash buckets of ``file_id``.

    data/_load=<id>/_buckets=<n>/file_bucket=<b>/   vectors and their columns
    files/_load=<id>/                               (file_id, n): what the load holds
    commits/_load=<id>/                             one row, written last: from then on the load counts

One folder per file would mean millions of tiny folders for millions of documents. A fixed number of
buckets keeps the listing small, and reading one file still opens a single bucket of each load, in which
the sorted ``file_id`` lets row groups be skipped.

A load replaces the files it holds: of every file the load committed last counts. Which loads of which
files are outdated is found from the narrow ``files`` tables when the vectors are read, and those rows are
left out by a join with that list, so vectors are never shuffled. A load with a key counts once, however
often it is tried; a load that failed before its commit was never there. ``compact`` writes what counts as
one load and retires the others.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsheet.functions.columns import require
from factsheet.functions.vectors import checked, l2_normalize

BUCKETS = 64
BUCKET = "file_bucket"
# The number of buckets and the load are part of the path, so that a reader needs to know neither.
LOAD, COUNT = "_load", "_buckets"
#: Outdated (file, load) pairs that are broadcast; beyond it they are joined by a shuffle until ``compact`` runs.
BROADCAST_ROWS = 1_000_000

_COMMIT = "key string, number bigint, rows bigint, files bigint, columns string, replaces array<string>"


class Commit(NamedTuple):
    """A committed load; ``number`` orders loads, ``columns`` is its schema, ``replaces`` the loads it retired."""

    load: str
    key: str | None
    number: int
    rows: int
    files: int
    columns: str
    replaces: list[str]


def file_bucket(file_id: Column, buckets: int | Column) -> Column:
    count = buckets if isinstance(buckets, Column) else F.lit(buckets)
    return F.pmod(F.xxhash64(file_id.cast("string")), count).cast("int")


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """All commits, oldest first: one small row for each load."""
    try:
        rows = spark.read.schema(f"{_COMMIT}, {LOAD} string").parquet(f"{path}/commits").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    found = [Commit(r[LOAD], r.key, r.number, r.rows, r.files, r.columns, r.replaces) for r in rows]
    return sorted(found, key=lambda c: (c.number, c.load))


def current_loads(spark: SparkSession, path: str) -> list[Commit]:
    """Commits that no later one retired."""
    found = commits(spark, path)
    retired = {load for c in found for load in c.replaces}
    return [c for c in found if c.load not in retired]


def add_vectors(
    vectors: DataFrame,
    path: str,
    dimension: int,
    buckets: int = BUCKETS,
    embedding: str = "embedding",
    key: str | None = None,
) -> bool:
    """Store unit-length vectors as a load of their own; a missing vector or a wrong dimension fails the load.

    The files of the load replace what earlier loads hold of them. With a ``key`` that is committed already
    nothing is written, and False returned: a batch that is run again after a failure counts once.

    The rebalance hint groups a bucket's rows into few files and lets AQE cut a bucket that one large file
    makes heavy.
    """
    require(vectors, "file_id", embedding)
    if key is not None and any(c.key == key for c in commits(vectors.sparkSession, path)):
        return False
    unit = l2_normalize(checked(F.col(embedding), dimension))
    _write(vectors.withColumn(embedding, unit), path, buckets, key)
    return True


def _write(rows: DataFrame, path: str, buckets: int, key: str | None, number: int | None = None, replaces: Sequence[str] = ()) -> None:
    spark, load = rows.sparkSession, uuid.uuid4().hex
    bucketed = rows.withColumn(BUCKET, file_bucket(F.col("file_id"), buckets))
    balanced = bucketed.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, "file_id")
    balanced.write.partitionBy(BUCKET).parquet(f"{path}/data/{LOAD}={load}/{COUNT}={buckets}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/data/{LOAD}={load}")
    held = written.groupBy(F.col("file_id").cast("string").alias("file_id")).agg(F.count(F.lit(1)).alias("n"))
    held.write.parquet(f"{path}/files/{LOAD}={load}")
    held = spark.read.schema("file_id string, n bigint").parquet(f"{path}/files/{LOAD}={load}")
    size = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("files")).first()
    # Loads are ordered by the time of their commit; what is compacted keeps its place among the others.
    entry = (key, time.time_ns() if number is None else number, size.rows, size.files, rows.schema.json(), list(replaces))
    spark.createDataFrame([entry], _COMMIT).coalesce(1).write.parquet(f"{path}/commits/{LOAD}={load}")


def _schema(loads: Sequence[Commit]) -> T.StructType:
    """The columns of all loads by name; the latest load decides a type."""
    fields: dict[str, T.StructField] = {}
    for c in loads:
        fields |= {f.name: f for f in T.StructType.fromJson(json.loads(c.columns)).fields}
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields.values()])


def _outdated(spark: SparkSession, path: str, loads: Sequence[Commit], file_id: str | None) -> DataFrame:
    """(_file, _outdated): files and the loads of them that a later load replaced."""
    order = spark.createDataFrame([(c.load, n) for n, c in enumerate(loads)], f"{LOAD} string, n int")
    paths = [f"{path}/files/{LOAD}={c.load}" for c in loads]
    files = spark.read.schema(f"file_id string, {LOAD} string").option("basePath", f"{path}/files").parquet(*paths)
    if file_id is not None:
        files = files.filter(F.col("file_id") == file_id)
    # One row for each load.
    placed = files.join(F.broadcast(order), LOAD)
    held = placed.groupBy("file_id").agg(F.sort_array(F.collect_set(F.struct("n", LOAD))).alias("loads")).filter(F.size("loads") > 1)
    older = F.explode(F.slice("loads", 1, F.size("loads") - 1))
    return held.select(F.col("file_id").alias("_file"), older.alias("o")).select("_file", F.col(f"o.{LOAD}").alias("_outdated"))


def read_vectors(spark: SparkSession, path: str, file_id: str | None = None) -> DataFrame:
    """All vectors, or those of one file: one bucket of each load is opened and the id reaches the scan."""
    loads = [c for c in current_loads(spark, path) if c.rows]
    return _read(spark, path, loads, file_id).drop(BUCKET, COUNT, LOAD)


def _read(spark: SparkSession, path: str, loads: Sequence[Commit], file_id: str | None = None) -> DataFrame:
    if not loads:
        known = commits(spark, path)
        if not known:
            raise ValueError(f"no vectors in {path}")
        return spark.createDataFrame([], _schema(known))
    kinds = _schema(loads).add(LOAD, T.StringType()).add(COUNT, T.IntegerType()).add(BUCKET, T.IntegerType())
    paths = [f"{path}/data/{LOAD}={c.load}" for c in loads]
    table = spark.read.schema(kinds).option("basePath", f"{path}/data").parquet(*paths)
    if file_id is not None:
        bucket = file_bucket(F.lit(file_id), F.col(COUNT))
        table = table.filter((F.col(BUCKET) == bucket) & (F.col("file_id") == file_id))
    if len(loads) == 1:
        return table
    outdated = _outdated(spark, path, loads, file_id)
    if outdated.isEmpty():
        return table
    few = outdated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = (F.col("file_id").cast("string") == F.col("_file")) & (F.col(LOAD) == F.col("_outdated"))
    return table.join(F.broadcast(outdated) if few else outdated, same, "left_anti")


def compact(spark: SparkSession, path: str, buckets: int = BUCKETS) -> int:
    """Write what counts as one load and retire the loads it came from; returns how many.

    Loads committed meanwhile stay, and stay later than the compacted one. ``clear_retired`` removes files.
    """
    loads = current_loads(spark, path)
    if len(loads) < 2:
        return 0
    rows = _read(spark, path, [c for c in loads if c.rows] or loads[:1]).drop(BUCKET, COUNT, LOAD)
    _write(rows, path, buckets, None, loads[-1].number, [c.load for c in loads])
    return len(loads)


def clear_retired(spark: SparkSession, path: str) -> int:
    """Remove the data of retired loads and of loads that were never committed; returns how many folders.

    Their commits stay, so that their keys stay known. Not while a load or a reader is at work.
    """
    keep = {f"{LOAD}={c.load}" for c in current_loads(spark, path)}
    hadoop = spark._jvm.org.apache.hadoop.fs
    removed = 0
    for part in ("data", "files"):
        root = hadoop.Path(f"{path}/{part}")
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(root):
            for s in fs.listStatus(root):
                if s.getPath().getName() not in keep:
                    removed += bool(fs.delete(s.getPath(), True))
    return removed


def vectors_of_file(vectors: DataFrame, file_id: str | int) -> DataFrame:
    return vectors.filter(F.col("file_id") == file_id)


def list_stores(vectors: DataFrame) -> DataFrame:
    """(file_id, num_vectors), ordered by id."""
    require(vectors, "file_id")
    return vectors.groupBy("file_id").agg(F.count(F.lit(1)).alias("num_vectors")).orderBy("file_id")


def store_stats(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(collections, num_vectors, size_bytes) of all stores; four bytes per vector component."""
    require(vectors, "file_id", embedding)
    per_file = vectors.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size(embedding).cast("bigint") * 4).alias("bytes")
    )
    return per_file.agg(
        F.count(F.lit(1)).alias("collections"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_vectors"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("size_bytes"),
    )
