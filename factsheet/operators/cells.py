"""Exact nearest neighbours for a query table of any size: a join by cells around pivots.

A bounded sample of the corpus gives pivots. Every corpus vector belongs to the cell of its nearest pivot and
to a ring of that cell by its distance from the pivot. Of each ring the least and greatest distance are
known, so the triangle inequality bounds how near a query can be to anything in it:

* d(q, x) >= d(q, p) - greatest, and d(q, x) >= least - d(q, p)
* d(q, x) >= (d(q, p) - d(q, j)) / 2 for every other pivot j, as x is nearer to p than to j

A query's k-th distance is at most that to the k-th nearest vector of the sample. Rings whose bound is
beyond it are left out; a query is sent to the others, and only rings that some query reaches are moved.

Rings that follow each other share a block up to a fixed size, rings with many rows are dealt over several blocks,
and blocks with many queries over several turns, so that a task holds one block of corpus rows at a time and
lets the queries stream past it. A query goes to a block once, with the numbers of the rings that it has to meet there,
and leaves it with its k best of all these rings. What grows with the data are rows of tables: pivots, sample and
ring bounds are fixed in number, and no query passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsheet.functions.columns import col
from factsheet.functions.session import staged

#: Vectors in the sample, and bytes of it, whatever the size of the corpus.
SAMPLE, SAMPLE_BYTES = 2048, 8 << 20
PIVOTS, RINGS = 256, 8
#: Rows from which a cell or ring is worth being told apart.
RING_ROWS = 1024
#: Bytes of vectors that a task holds of the corpus, and rows of queries in one turn.
BLOCK_BYTES = 16 << 20
TURN_ROWS = 1 << 16
#: Distances computed at a time in a task.
CELLS = 1 << 20
#: Rows whose vectors are scaled at a time.
UNIT_ROWS = 4096
#: Queries that meet a block at a time, and tasks at most that blocks and turns are dealt to.
STEP_QUERIES, TASKS = 1024, 4096
#: Squared distances are compared after rounding to this many digits, so that equal vectors tie and ids decide.
DIGITS = 9
#: Doubt of a distance that is the root of a rounded square.
SLACK = 1e-4

_BLOCK = ["_block", "_turn"]


def unit_rows(m: np.ndarray) -> np.ndarray:
    out = np.zeros(m.shape)
    for start in range(0, len(m), UNIT_ROWS):
        part = m[start : start + UNIT_ROWS].astype(np.float64)
        norm = np.sqrt((part * part).sum(axis=1, keepdims=True))
        np.divide(part, norm, out=out[start : start + UNIT_ROWS], where=norm > 0)
    return out


def matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    """A list column as rows; a missing vector or a wrong dimension fails the task."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(vectors), -1)
    if len(vectors) and not pc.all(pc.equal(lengths, dimension)).as_py():
        raise ValueError(f"a vector does not have dimension {dimension}")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dimension)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T), 0.0)


def smallest(distances: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the k smallest cells of each row not beyond its limit; ties by column."""
    if distances.shape[1] > k:
        limit = np.minimum(limit, np.partition(distances, k - 1, axis=1)[:, k - 1 : k])
    at, column = np.nonzero(distances <= limit)
    near = distances[at, column]
    order = np.lexsort((column, near, at))
    order = order[np.arange(len(at)) - np.searchsorted(at, at, side="left") < k]
    return at[order], column[order], near[order]


class Grid(NamedTuple):
    """Pivots, sample, and of each ring its number, cell, and least and greatest distance from the pivot."""

    pivots: np.ndarray
    sample: np.ndarray
    ring: np.ndarray
    cell: np.ndarray
    least: np.ndarray
    greatest: np.ndarray

    def reached(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A bound of each query's k-th distance, and for each ring whether it may hold one of its k nearest."""
        to_sample = np.sqrt(squared_distances(queries, self.sample))
        bound = np.partition(to_sample, k - 1, axis=1)[:, k - 1] if len(self.sample) >= k else np.full(len(queries), np.inf)
        to_pivots = np.sqrt(squared_distances(queries, self.pivots))
        d = to_pivots[:, self.cell]
        low = np.maximum(np.maximum(d - self.greatest, self.least - d), (d - to_pivots.min(axis=1, keepdims=True)) / 2)
        return bound, low <= bound[:, None] + SLACK


def _place(pivots: np.ndarray) -> Column:
    """struct(cell, reach) of a vector: its nearest pivot and the distance to it."""

    @F.arrow_udf("cell int, reach double")
    def place(vectors: pa.Array) -> pa.Array:
        cells, reaches = [], []
        step = max(1, CELLS // len(pivots))
        for start in range(0, len(vectors), step):
            d = squared_distances(unit_rows(matrix(vectors.slice(start, step), pivots.shape[1])), pivots)
            cells.append(d.argmin(axis=1))
            reaches.append(np.sqrt(d.min(axis=1)))
        cell, reach = (np.concatenate(x) if x else np.zeros(0) for x in (cells, reaches))
        return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(reach, pa.float64())], ["cell", "reach"])

    return place(F.col("_vector"))


def _reaching(asked: DataFrame, grid: Grid, k: int) -> DataFrame:
    """(_ring, n): how many queries each ring is asked by, from each step of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, reached) in _steps(batches, grid, k):
            n = reached.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(grid.ring[n > 0], pa.int32()), pa.array(n[n > 0], pa.int64())], names=["_ring", "n"])

    return asked.select("_vector").mapInArrow(count, "_ring int, n bigint")


def _steps(batches: Iterator[pa.RecordBatch], grid: Grid, k: int):
    """Queries a few at a time, each with what they reach."""
    step = max(1, CELLS // max(len(grid.sample), len(grid.cell)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield part, grid.reached(unit_rows(matrix(part.column(part.schema.get_field_index("_vector")), grid.pivots.shape[1])), k)


def _sent(asked: DataFrame, grid: Grid, k: int, pieces: list[tuple[int, int]]) -> DataFrame:
    """Queries once for each block that they reach, with a bound and their rings there; ``pieces`` are (ring, block) pairs."""
    pieces = sorted(pieces, key=lambda p: (p[1], p[0]))
    ring, block = (np.array(x, np.int32) for x in zip(*pieces))
    column = np.searchsorted(grid.ring, ring)
    schema = T.StructType([*asked.select("query_id", "_vector").schema, T.StructField("_bound", T.DoubleType()), T.StructField("_block", T.IntegerType()), T.StructField("_rings", T.ArrayType(T.IntegerType()))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (bound, reached) in _steps(batches, grid, k):
            at, piece = np.nonzero(reached[:, column])
            if not len(at):
                continue
            to = block[piece]
            first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (to[1:] != to[:-1])))
            rings = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(ring[piece]))
            rows = part.select(["query_id", "_vector"]).take(pa.array(at[first]))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(bound[at[first]]), pa.array(to[first]), rings], names=schema.names)

    return asked.select("query_id", "_vector").mapInArrow(send, schema)


def _blocks(rows: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(ring, first block, blocks) of each ring and its number of rows: small ones share a block, large ones fill several."""
    found, number, held = [], -1, most
    for ring, n in rows:
        if n > most:
            many = -(-n // most)
            found.append((ring, number + 1, many))
            number, held = number + many, most
        else:
            if held + n > most:
                number, held = number + 1, 0
            found.append((ring, number, 1))
            held += n
    return found


def _sample(corpus: DataFrame, ids: Sequence[str], n: int, rows: int, dimension: int) -> np.ndarray:
    """At most ``rows`` corpus vectors, chosen by the digests of their ids."""
    share = min(1.0, 1.3 * rows / n)
    chosen = corpus.filter(F.pmod(F.xxhash64(*[col(c) for c in ids]), F.lit(1 << 40)) <= int(share * (1 << 40)))
    table = chosen.select("_vector").limit(rows).toArrow()
    if not len(table):
        # Few rows, none of which was chosen.
        table = corpus.select("_vector").limit(rows).toArrow()
    return unit_rows(matrix(table["_vector"], dimension))


def _ringed(rows: DataFrame, cuts: dict[int, list[float]]) -> DataFrame:
    """Add ``_ring``: a row's cell, and how many of the cell's cuts its distance from the pivot exceeds."""
    # At most PIVOTS rows.
    table = rows.sparkSession.createDataFrame(list(cuts.items()), "_cell int, _cuts array<double>")
    inner = F.size(F.filter("_cuts", lambda x: x < F.col("_reach")))
    return rows.join(F.broadcast(table), "_cell").withColumn("_ring", F.col("_cell") * RINGS + inner).drop("_cuts")


def _cuts(places: DataFrame) -> dict[int, list[float]]:
    """Distances that cut each cell into as many rings as it has rows for."""
    shares = [i / RINGS for i in range(1, RINGS)]
    found = places.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_reach", shares, 1000).alias("at")).collect()
    cuts = {}
    for r in found:
        parts = max(1, min(RINGS, r.n // RING_ROWS))
        cuts[r["_cell"]] = sorted({r["at"][RINGS * i // parts - 1] for i in range(1, parts)})
    return cuts


def _join(dimension: int, k: int, ids: Sequence[str]):
    """A task function: blocks of corpus rows, each followed by its queries, in; the k best rows per query and block out."""
    sort_keys = [(c, "ascending") for c in ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in _BLOCK], axis=1)
            is_query = batch.column("_query").to_numpy(zero_copy_only=False).astype(bool)
            change = np.any(keys[1:] != keys[:-1], axis=1) | (is_query[1:] != is_query[:-1])
            starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                part = pa.Table.from_batches([batch.slice(start, end - start)])
                key = tuple(keys[start])
                if key != block:
                    block, waiting, ready = key, [], None
                if not is_query[start]:
                    waiting.append(part.select([*ids, "_at", "_ring", "_vector"]))
                elif waiting:
                    if ready is None:
                        found, waiting = waiting, [waiting[0].schema.empty_table()]
                        ready = laid_out(found)
                    yield from best(part, *ready)

    def laid_out(waiting: list[pa.Table]) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """Rows by ring, there in id order, as among equal distances the first ones have the smallest ids; vectors, rings and ranks of ids.

        Vectors are taken out of the list one table at a time, so that they are not held twice.
        """
        narrow = pa.concat_tables([t.drop(["_vector"]) for t in waiting])
        order = pc.sort_indices(narrow, sort_keys=[("_ring", "ascending"), *sort_keys])
        rows = narrow.take(order).combine_chunks()
        spot = np.empty(len(rows), np.int64)
        spot[order.to_numpy()] = np.arange(len(rows))
        vectors, start = np.empty((len(rows), dimension)), 0
        waiting.reverse()
        while waiting:
            some = waiting.pop()["_vector"]
            vectors[spot[start : start + len(some)]] = unit_rows(matrix(some, dimension))
            start += len(some)
        rank = np.empty(len(rows), np.int64)
        rank[pc.sort_indices(rows, sort_keys=sort_keys).to_numpy()] = np.arange(len(rows))
        return rows.drop(["_ring"]), vectors, rows["_ring"].to_numpy(), rank

    def best(queries: pa.Table, rows: pa.Table, vectors: np.ndarray, ring: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(queries), STEP_QUERIES):
            some = queries.slice(start, STEP_QUERIES).combine_chunks()
            q = unit_rows(matrix(some["_vector"], dimension))
            limit = (some["_bound"].to_numpy()[:, None] + SLACK) ** 2
            lists = some["_rings"].combine_chunks()
            asker = np.repeat(np.arange(len(some)), pc.list_value_length(lists).to_numpy())
            asked = lists.flatten().to_numpy()
            order = np.argsort(asked, kind="stable")
            asker, asked = asker[order], asked[order]
            cuts = np.flatnonzero(np.append(True, asked[1:] != asked[:-1])) if len(asked) else np.zeros(0, int)
            kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for low, high in zip(cuts, np.append(cuts[1:], len(asked))):
                who = asker[low:high]
                first, last = np.searchsorted(ring, asked[low], "left"), np.searchsorted(ring, asked[low], "right")
                step = max(1, CELLS // max(1, len(who)))
                for top in range(first, last, step):
                    end = min(last, top + step)
                    d = np.round(squared_distances(q[who], vectors[top:end]), DIGITS)
                    at, row, near = smallest(d, limit[who], k)
                    if len(at):
                        at, row, near = (np.concatenate(x) for x in zip(kept, (who[at], top + row, near)))
                        order = np.lexsort((rank[row], near, at))
                        at, row, near = at[order], row[order], near[order]
                        place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
                        limit[at[place == k - 1], 0] = np.minimum(limit[at[place == k - 1], 0], near[place == k - 1])
                        kept = tuple(x[place < k] for x in (at, row, near))
            at, row, near = kept
            if len(at):
                found = rows.take(pa.array(row)).append_column("distance", pa.array(near))
                found = found.append_column("query_id", some["query_id"].take(pa.array(at)))
                yield from found.combine_chunks().to_batches()

    return run


def cell_join(corpus: DataFrame, queries: DataFrame, k: int, ids: Sequence[str]) -> tuple[DataFrame, DataFrame, dict]:
    """Candidates (query_id, distance, ids, _at): the k best rows of each query in every block it was sent to.

    ``corpus`` has ids, further columns and ``_vector``; ``queries`` has query_id and ``_vector``. Both are
    stored once. Also returned: the stored corpus, whose ``_at`` tells its rows apart, and figures of the
    join (rings, rings reached, pairs of queries and rings).
    """
    spark = corpus.sparkSession
    asked = staged(queries.select("query_id", "_vector"), "queries")
    some = asked.select("_vector").first()
    n = corpus.count()
    schema = T.StructType([*[corpus.schema[c] for c in ids], T.StructField("_at", T.LongType()), T.StructField("distance", T.DoubleType()), queries.schema["query_id"]])
    if some is None or not n:
        return spark.createDataFrame([], schema), corpus.withColumn("_at", F.monotonically_increasing_id()), {"rings": 0, "reached": 0, "pairs": 0}
    dimension = len(some["_vector"] or [])
    sample = _sample(corpus, ids, n, max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, dimension)))), dimension)
    pivots = sample[: max(1, min(PIVOTS, n // RING_ROWS))]
    placed = corpus.withColumn("_place", _place(pivots)).withColumns(
        {"_at": F.monotonically_increasing_id(), "_cell": F.col("_place.cell"), "_reach": F.col("_place.reach")}
    )
    stored = staged(placed.drop("_place"), "cells")
    cuts = _cuts(stored.select("_cell", "_reach"))
    stats = (
        _ringed(stored.select("_cell", "_reach"), cuts)
        .groupBy("_ring", "_cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_reach").alias("least"), F.max("_reach").alias("greatest"))
        .collect()
    )
    numbers, cell, rows, least, greatest = (np.array(x) for x in zip(*sorted(stats)))
    grid = Grid(pivots, sample, numbers, cell, least, greatest)
    asking = {r["_ring"]: r["n"] for r in _reaching(asked, grid, k).groupBy("_ring").agg(F.sum("n").alias("n")).collect()}
    block_rows = max(1, BLOCK_BYTES // (4 * max(1, dimension)))
    plan = _blocks([(r, m) for r, m in zip(numbers.tolist(), rows.tolist()) if r in asking], block_rows)
    if not plan:
        return spark.createDataFrame([], schema), stored, {"rings": len(numbers), "reached": 0, "pairs": 0}
    sent = _sent(asked, grid, k, [(r, b + i) for r, b, many in plan for i in range(many)])
    # A block is asked at most by all its rings' queries and by all queries. One row for each ring that is reached.
    queries_of, total = {}, asked.count()
    for r, b, many in plan:
        for i in range(b, b + many):
            queries_of[i] = min(total, queries_of.get(i, 0) + asking[r])
    # Few blocks are shared by more turns, so that all cores have one.
    cores = -(-2 * spark.sparkContext.defaultParallelism // len(queries_of))
    turns = {b: max(-(-n // TURN_ROWS), min(-(-n // STEP_QUERIES), cores)) for b, n in queries_of.items()}
    table = F.broadcast(spark.createDataFrame([(r, b, many, turns[b]) for r, b, many in plan], "_ring int, _first int, _subs int, _turns int"))
    turn_of = F.broadcast(spark.createDataFrame(list(turns.items()), "_block int, _turns int"))

    def dealt(count: str, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    side = _ringed(stored.select(*map(col, ids), "_at", "_vector", "_cell", "_reach"), cuts).drop("_cell", "_reach").join(table, "_ring")
    side = side.withColumns({"_block": F.col("_first") + dealt("_subs", "_at"), "_turn": F.explode(F.sequence(F.lit(0), F.col("_turns") - 1)), "_query": F.lit(False)})
    other = sent.join(turn_of, "_block").withColumns({"_turn": dealt("_turns", "query_id"), "_query": F.lit(True)})
    both = side.drop("_first", "_subs", "_turns").unionByName(other.drop("_turns"), allowMissingColumns=True)
    met = both.repartition(min(sum(turns.values()), TASKS), *_BLOCK).sortWithinPartitions(*_BLOCK, "_query")
    figures = {"rings": len(numbers), "reached": len(plan), "pairs": sum(asking.values())}
    return met.mapInArrow(_join(dimension, k, ids), schema), stored, figures
