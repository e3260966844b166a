"""Exact nearest neighbours for a table of queries, and the two searches built on it.

A query table that fits a block of fixed size is shipped to the tasks that read the corpus, which never
moves: each task scores its rows against the block with one matrix product per Arrow batch, keeps the
k best per query, and only those rows are shuffled. A larger query table is joined by cells
(``operators.cells``): it never passes through the driver, and the corpus is read as often whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsheet.functions.columns import ROW_INDEX, col, require
from factsheet.functions.session import staged
from factsheet.functions.text import fixed_text
from factsheet.functions.vectors import score_text, similarity
from factsheet.operators.answer import Answer
from factsheet.operators.cells import CELLS, DIGITS, cell_join, matrix, smallest, unit_rows

# What a block of query vectors that is shipped to all tasks has at most, in bytes and in rows.
QUERY_BLOCK_BYTES = 32 << 20
FIRST_QUERIES = 8192
PARTITIONS_PER_MERGE = 1024
BROADCAST_ROWS = 1_000_000
CONTEXT_PAIRS = 3
# The wording of a retrieval context.
RELEVANCE = ("[Relevance: ", "] ")
PAIR_LABELS = ("Q: ", "A: ", "Analysis: ")
PAIRS_HEADING = "\n\nRelevant Q&A pairs from analysis:\n"


def _query_block(queries: DataFrame, most: int) -> pa.Table | None:
    """The query vectors as one Arrow table, or None if they are more than ``most`` bytes."""
    start = queries.limit(FIRST_QUERIES + 1).toArrow()
    width = pc.max(pc.list_value_length(start["_vector"])).as_py() or 0
    return start if len(start) <= FIRST_QUERIES and 4 * len(start) * width <= most else None


def _best_rows(shared, k: int, ids: Sequence[str], kept: Sequence[str]):
    """A task function: corpus batches in, the k best rows per query of the whole task out.

    Pairs (query, distance, row) are kept as arrays; the rows they point to are kept once.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = pa.ipc.open_stream(shared.value).read_all()
        query_ids = data["query_id"].combine_chunks()
        dimension = pc.max(pc.list_value_length(data["_vector"])).as_py()
        q = unit_rows(matrix(data["_vector"], dimension))
        q_norm = (q * q).sum(axis=1)[:, None]
        slice_rows = max(1, CELLS // len(q))
        bound = np.full((len(q), 1), np.inf)
        sort_keys = [(c, "ascending") for c in ids]
        rows: list[pa.Table] = []
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        offset = waiting = 0

        def cut() -> None:
            nonlocal rows, pairs, offset, waiting
            table = pa.concat_tables(rows)
            at, near, row = (np.concatenate(p) for p in zip(*pairs))
            by_id = pc.sort_indices(table, sort_keys=sort_keys).to_numpy()
            id_rank = np.empty(len(by_id), np.int64)
            id_rank[by_id] = np.arange(len(by_id))
            order = np.lexsort((id_rank[row], near, at))
            at, near, row = at[order], near[order], row[order]
            place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
            bound[at[place == k - 1], 0] = near[place == k - 1]
            at, near, row = (x[place < k] for x in (at, near, row))
            used = np.unique(row)
            rows = [table.take(pa.array(used)).combine_chunks()]
            pairs = [(at, near, np.searchsorted(used, row))]
            offset, waiting = len(used), 0

        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows in id order: among equal distances the first ones have the smallest ids.
            batch_rows = pa.Table.from_batches([batch]).sort_by(sort_keys).combine_chunks()
            vectors = unit_rows(matrix(batch_rows["_vector"], dimension))
            batch_rows = batch_rows.select(list(kept))
            for first in range(0, len(vectors), slice_rows):
                v = vectors[first : first + slice_rows]
                d = np.round(np.maximum(q_norm + (v * v).sum(axis=1)[None, :] - 2.0 * (q @ v.T), 0.0), DIGITS)
                at, row, near = smallest(d, bound, k)
                if not len(at):
                    continue
                used = np.unique(row)
                rows.append(batch_rows.slice(first, len(v)).take(pa.array(used)))
                pairs.append((at, near, offset + np.searchsorted(used, row)))
                offset += len(used)
                waiting += len(at)
                if waiting > 4 * k * len(q):
                    cut()
        if pairs:
            cut()
            at, near, row = pairs[0]
            found = rows[0].take(pa.array(row))
            found = found.append_column("distance", pa.array(near)).append_column("query_id", query_ids.take(pa.array(at)))
            yield from found.combine_chunks().to_batches()

    return score


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 5,
    ids: str | Sequence[str] = "vec_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    keep: Sequence[str] = (),
    file_id: str | int | None = None,
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """(query_id, rank, distance, ids, kept columns): the k nearest rows of every query.

    ``distance`` is the squared Euclidean distance of the unit vectors; ties are broken by
    the ids. ``file_id`` restricts the corpus before it is searched.
    """
    return _nearest(corpus, queries, k, ids, vector, query_id, query_vector, keep, file_id, block_bytes)[0]


def _nearest(corpus, queries, k, ids, vector, query_id, query_vector, keep, file_id, block_bytes):
    if k <= 0:
        raise ValueError("k must be positive")
    ids = [ids] if isinstance(ids, str) else list(ids)
    require(corpus, *ids, *keep, vector)
    require(queries, query_id, query_vector)
    if file_id is not None:
        corpus = corpus.filter(F.col("file_id") == file_id)
    kept = list(dict.fromkeys([*ids, *keep]))
    if not queries.groupBy(col(query_id)).count().filter("count > 1").isEmpty():
        raise ValueError(f"{query_id} is not unique")
    asked = queries.select(col(query_id).alias("query_id"), col(query_vector).alias("_vector"))
    rows = corpus.select(*[col(c) for c in kept], col(vector).alias("_vector"))
    columns = [col(c) for c in kept if c != "query_id"]
    block = _query_block(asked, block_bytes)
    if block is None:
        best, table, _ = cell_join(rows, asked, k, ids)
        ranked = _merged(best, k, ids)
        if set(kept) != set(ids):
            # Only the hits get the other columns, by the position of their row in the stored corpus.
            hits = staged(ranked.select("query_id", "rank", "distance", "_at"), "hits")
            few = hits.count() <= BROADCAST_ROWS
            ranked = table.select("_at", *columns).join(F.broadcast(hits) if few else hits, "_at")
        return ranked.select("query_id", "rank", "distance", *columns), None
    out = T.StructType(
        [corpus.schema[c] for c in kept]
        + [T.StructField("distance", T.DoubleType()), T.StructField("query_id", queries.schema[query_id].dataType)]
    )
    spark = corpus.sparkSession
    best = rows.mapInArrow(_task(spark, block, k, ids, kept), out) if len(block) else spark.createDataFrame([], out)
    return _merged(best, k, ids).select("query_id", "rank", "distance", *columns), len(block)


def _merged(best: DataFrame, k: int, ids: Sequence[str]) -> DataFrame:
    """The k best of all candidates of each query, with their rank.

    Each task hands over k rows per query. Groups of tasks are merged first, so that the last merge of a
    query sees few rows however many tasks there were.
    """
    order = [F.col("distance"), *[col(c) for c in ids]]
    best = best.withColumn("_group", F.floor(F.spark_partition_id() / PARTITIONS_PER_MERGE))
    first = W.partitionBy("query_id", "_group").orderBy(*order)
    best = best.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_r", "_group")
    last = W.partitionBy("query_id").orderBy(*order)
    return best.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)


def _task(spark, block, k, ids, kept):
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema) as writer:
        writer.write_table(block)
    return _best_rows(spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), k, ids, kept)


def _check_top_k(top_k: int) -> None:
    if not 1 <= top_k <= 10:
        raise ValueError("top_k must be from 1 to 10")


def explain_row(
    df: DataFrame,
    units: DataFrame,
    queries: DataFrame,
    top_k: int = 1,
    key: str = ROW_INDEX,
    file_id: str | None = None,
    rows_only: bool = False,
    query_id: str = "query_id",
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> Answer:
    """The rows of a table closest to each query, with all their columns.

    ``units`` are the embedded units of the table (rows and column summaries). A summary among
    the top_k takes a place and is dropped; ``rows_only`` searches the rows alone.
    """
    _check_top_k(top_k)
    if "is_row_vector" not in units.columns:
        raise ValueError("not the units of a table: no column is_row_vector")
    require(df, key)
    pool = units.filter("is_row_vector") if rows_only else units
    ids = ["file_id", "row_idx", "column_name"]
    hits, n_queries = _nearest(
        pool, queries, top_k, ids, "embedding", query_id, "embedding", ["is_row_vector"], file_id,
        block_bytes,
    )
    rows = hits.filter("is_row_vector").select(
        "query_id", "rank", F.col("row_idx").alias("_row_index"), similarity(F.col("distance")).alias("_similarity_score"),
        F.col("file_id").alias("_file"),
    )
    # At most top_k rows per query: broadcast while that is a bounded number of rows.
    picked = F.broadcast(rows) if n_queries is not None and n_queries * top_k <= BROADCAST_ROWS else rows
    table = df.withColumn("_row_index", col(key).cast("bigint"))
    # Positions are unique within a file only.
    same = ["_row_index"]
    if "file_id" in df.columns:
        picked, same = picked.withColumnRenamed("_file", "file_id"), ["file_id", "_row_index"]
    else:
        picked = picked.drop("_file")
    result = table.join(picked, same).select(
        "query_id", "rank", *[col(c) for c in df.columns if c != "_row_index"], "_row_index", "_similarity_score"
    )
    pairs = F.array_sort(F.collect_list(F.struct("rank", "_row_index", "_similarity_score")))
    numbers = (
        queries.select(col(query_id).alias("query_id"))
        .unionByName(rows, allowMissingColumns=True)
        .groupBy("query_id")
        .agg(
            F.filter(pairs, lambda p: p["rank"].isNotNull()).alias("p"),
            F.first("_file", ignorenulls=True).alias("file_id"),
        )
        .select(
            "query_id",
            F.lit(top_k).alias("top_k"),
            F.col("p._row_index").alias("row_indices"),
            F.col("p._similarity_score").alias("similarity_scores"),
            "file_id",
        )
    )
    return Answer(result, numbers)


def document_query(
    units: DataFrame,
    queries: DataFrame,
    top_k: int = 3,
    file_id: str | int | None = None,
    query_id: str = "query_id",
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> Answer:
    """The passages closest to each query over all documents (or one), best first.

    Searching everything at once gives the same rows as searching document by document and
    merging the lists.
    """
    _check_top_k(top_k)
    if "chunk_type" not in units.columns:
        raise ValueError("not the units of documents: no column chunk_type")
    stored = ["chunk_type", "original_text", "question_text", "answer_text", "analysis_text"]
    hits = nearest(
        units, queries, top_k, ["file_id", "chunk_idx"], query_id=query_id, keep=stored, file_id=file_id,
        block_bytes=block_bytes,
    )
    result = hits.select(
        "query_id",
        "rank",
        "file_id",
        "chunk_idx",
        "chunk_type",
        similarity(F.col("distance")).alias("similarity"),
        score_text(similarity(F.col("distance"))).alias("similarity_score"),
        F.col("original_text").alias("content"),
        F.col("question_text").alias("question"),
        F.col("answer_text").alias("answer"),
        F.col("analysis_text").alias("analysis"),
    )
    return Answer(result, document_numbers(result, queries, query_id))


def document_numbers(result: DataFrame, queries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Per query: hits, mean similarity (0 without hits), and the documents hit."""
    return (
        queries.select(col(query_id).alias("query_id"))
        .unionByName(result.select("query_id", "similarity", "file_id"), allowMissingColumns=True)
        .groupBy("query_id")
        .agg(
            F.count("similarity").alias("num_results"),
            F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("avg_similarity"),
            F.array_sort(F.collect_set("file_id")).alias("file_ids"),
        )
    )


def document_context(result: DataFrame, context_pairs: int = CONTEXT_PAIRS) -> DataFrame:
    """(query_id, context_text, qa_context): what an answer to each query can be read from.

    All passages with their relevance, and the first ``context_pairs`` hits that are question/answer pairs.
    """
    line = F.concat(F.lit(RELEVANCE[0]), fixed_text(F.col("similarity"), 2), F.lit(RELEVANCE[1]), F.col("content"))
    pair = F.concat_ws(
        "\n",
        F.concat(F.lit(PAIR_LABELS[0]), F.col("question")),
        F.concat(F.lit(PAIR_LABELS[1]), F.col("answer")),
        F.when(F.col("analysis") != "", F.concat(F.lit(PAIR_LABELS[2]), F.col("analysis"))),
    )
    has_pair = (F.col("question") != "") & (F.col("answer") != "")
    listed = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), F.when(has_pair, pair).alias("pair"))))
    pairs = F.slice(F.filter(F.col("p.pair"), lambda x: x.isNotNull()), 1, context_pairs)
    block = F.concat(F.lit(PAIRS_HEADING), F.array_join(pairs, "\n\n"))
    return (
        result.groupBy("query_id")
        .agg(listed.alias("p"))
        .select(
            "query_id",
            F.array_join("p.line", "\n\n").alias("context_text"),
            F.when(F.size(pairs) > 0, block).otherwise(F.lit("")).alias("qa_context"),
        )
    )
