"""Centroid clustering of vectors in whole numbers, with a pivot table that spares distances (LAESA).

Components become integers, so every distance, sum and mean is exact and no order of rows or tasks can
change a cluster. A few fixed pivots are taken among the first centroids, each farthest from those before.
Every vector's distances to them are stored once, beside the vector. In each round the driver holds the
centroids (``k`` vectors) and their distances to the pivots; for a pivot p, |d(x, p) - d(c, p)| is at most
d(x, c), so a centroid whose bound exceeds the best distance found so far is out. The one of the least
bound is tried first; the others get their exact distance only while they survive.

A round reads the stored table once. A task sums what it assigned by cluster, so ``k`` rows a task are
shuffled however the vectors fall, and ``k`` rows reach the driver. Nothing but the stored table is an
ancestor of a round, so a lost executor costs its tasks alone.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are left
out; null ids are ids like others; equal rows are rows of their own; fewer vectors than ``k`` make as many
centroids; an empty table gives an empty result. Components beyond 2^27 after scaling count as 2^27, so
that a squared distance fits 64 bits. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsheet.llm.common import picked, stored

#: Largest size of a component: 64 squares of differences stay below 2^63.
LARGEST = 1 << 27
PIVOTS = 8
#: Doubts of the square roots, as a share of what is compared.
DOUBT = 1e-12


class Clustering(NamedTuple):
    """``assigned`` (vec_id, cluster, distance) and ``centroids`` (cluster, centroid, n, inertia)."""

    assigned: DataFrame
    centroids: DataFrame


def whole_vectors(vectors: DataFrame, dimension: int, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, point): the vectors that count, in whole numbers."""
    rows = picked(vectors, (vec_id, "vec_id"), (embedding, "v"))
    far = F.lit(float(LARGEST))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    point = F.transform("v", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, far), -far)).cast("int"))
    return rows.filter((F.size("v") == dimension) & usable).select("vec_id", point.alias("point"))


def first_centroids(points: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors whose salted ids have the least digests; ties by the vectors themselves."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = points.select(digest.alias("digest"), "point").orderBy("digest", "point").limit(k).collect()
    return np.array([r.point for r in chosen], np.int64)


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the points, each the one farthest from those before it."""
    chosen, near = [0], np.full(len(points), np.iinfo(np.int64).max)
    while len(chosen) < n:
        near = np.minimum(near, squared(points, points[chosen[-1]]))
        if not near.any():
            break
        chosen.append(int(near.argmax()))
    return points[chosen]


def squared(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    apart = points - other
    return np.einsum("ij,ij->i", apart, apart)


def to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(points, p) for p in pivots], axis=1).astype(np.float64))


def assign(points: np.ndarray, roots: np.ndarray, centroids: np.ndarray, centroid_roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: the least number), squared distance, and how many distances that took."""
    low = np.zeros((len(points), len(centroids)))
    for p in range(roots.shape[1]):
        x, c = roots[:, p, None], centroid_roots[None, :, p]
        np.maximum(low, np.abs(x - c) - DOUBT * (x + c), out=low)
    low *= low * (1 - DOUBT)
    number = low.argmin(axis=1)
    first = number.copy()
    best = squared(points, centroids[number])
    taken = len(points)
    for c in range(len(centroids)):
        left = np.flatnonzero((low[:, c] <= best) & (first != c))
        if len(left):
            taken += len(left)
            distance = squared(points[left], centroids[c])
            nearer = (distance < best[left]) | ((distance == best[left]) & (c < number[left]))
            left = left[nearer]
            best[left], number[left] = distance[nearer], c
    return number, best, taken


def _rows(column: pa.Array, kind) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _with_pivots(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    schema = T.StructType([*points.schema.fields, T.StructField("roots", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                roots = to_pivots(_rows(batch.column("point"), np.int64), pivots)
                ends = np.arange(len(roots) + 1, dtype=np.int32) * roots.shape[1]
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(roots.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "roots"])

    return points.mapInArrow(run, schema)


def _sums(table: DataFrame, centroids: np.ndarray, centroid_roots: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Rows and component sums of each non-empty cluster."""
    k, dimension = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dimension), np.int64)
        for batch in batches:
            if batch.num_rows:
                points = _rows(batch.column("point"), np.int64)
                number, _, _ = assign(points, _rows(batch.column("roots"), np.float64), centroids, centroid_roots)
                n += np.bincount(number, minlength=k)
                np.add.at(sums, number, points)
        used = np.flatnonzero(n)
        columns = [pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    parts = table.select("point", "roots").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dimension)]).alias("sums"))
    return {r.cluster: (r.n, r.sums) for r in total.collect()}


def _assigned(table: DataFrame, centroids: np.ndarray, centroid_roots: np.ndarray) -> DataFrame:
    schema = T.StructType([table.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points, roots = _rows(batch.column("point"), np.int64), _rows(batch.column("roots"), np.float64)
                number, distance, _ = assign(points, roots, centroids, centroid_roots)
                columns = [batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, schema)


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dimension: int = 64,
    scale: int = 256,
    salt: str = "2:",
    pivots: int = PIVOTS,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> Clustering:
    """``rounds`` rounds of assigning and averaging from the first centroids on, and a last assignment."""
    spark = vectors.sparkSession
    points = whole_vectors(vectors, dimension, scale, vec_id, embedding)
    centroids = first_centroids(points, k, salt)
    kinds = "cluster int, centroid array<bigint>, n bigint, inertia bigint"
    if not len(centroids):
        none = points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return Clustering(none, spark.createDataFrame([], kinds))
    fixed = farthest_first(centroids, pivots)
    table = stored(_with_pivots(points, fixed), "pivots")
    for _ in range(rounds):
        for number, (n, sums) in _sums(table, centroids, to_pivots(centroids, fixed)).items():
            centroids[number] = [s // n for s in sums]
    assigned = stored(_assigned(table, centroids, to_pivots(centroids, fixed)), "assigned")
    # k rows; a sum beyond 64 bits is null.
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).try_cast("bigint").alias("inertia")
    held = {r.cluster: r for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), exact).collect()}
    rows = [(c, p, held[c].n if c in held else 0, held[c].inertia if c in held else 0) for c, p in enumerate(centroids.tolist())]
    return Clustering(assigned, spark.createDataFrame(rows, kinds))
