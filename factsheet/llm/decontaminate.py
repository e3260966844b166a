"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are split by their number of distinct five-word shingles into classes [2^c, 2^(c+1)). The MinHash
sketch of an item is its k shingles that come first by (frequency among items, hash), with k set by its
class: k = floor((1 - threshold) * (2^(c+1) - 1)) + 1. A text that holds ``threshold`` of the item's
shingles misses fewer than k, so it holds at least one of the sketch: searching the documents' shingles
for sketches loses nothing, however long the document. (Sketches of whole documents can't do this: the
Jaccard similarity of a short item and a long document is near 0.) Candidates are then verified by the
share of the item's distinct shingles that the document contains, compared as text.

The documents' shingles are streamed from the scan through a hash join and never shuffled or stored.
The sketches are broadcast up to a checked number of rows and joined by a shuffle beyond it.

Defined cases: items of one to four words have one shingle, the whole item; items without words are in
no document; null and empty texts contain nothing; equal items under several ids each get rows; rows
of documents that share an id, null included, count as one document; empty tables give empty results;
columns other than the named ones are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factsheet.llm.common import is_small, joined, picked, stored, words

SHINGLE = 5


def shingles(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """``keep`` columns, hash and text of each run of ``size`` words of column ``words``, repeats included."""
    n = F.size("words") - (size - 1)
    parts = [F.slice("words", k + 1, n) for k in range(size)]
    each = rows.filter(F.size("words") >= size).select(*keep, F.explode(F.arrays_zip(*parts)).alias("s"))
    fields = [F.col(f"s.`{k}`") for k in range(size)]
    return each.select(*keep, F.xxhash64(*fields).alias("h"), F.concat_ws(" ", *fields).alias("shingle"))


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item (digest of id and text), item_id, size of its shingles, h, shingle, n distinct shingles."""
    rows = picked(items, (item_id, "item_id"), (text, "text")).select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    rows = rows.withColumn("size", F.least(F.size("words"), F.lit(SHINGLE)))
    rows = rows.withColumn("item", F.xxhash64(F.col("item_id").cast("string"), F.col("words")))
    every = None
    for size in range(1, SHINGLE + 1):
        part = shingles(rows.filter(F.col("size") == size), size, "item", "item_id", "size")
        every = part if every is None else every.unionByName(part)
    per_item = Window.partitionBy("item")
    return every.distinct().withColumn("n", F.count(F.lit(1)).over(per_item))


def sketches(found: DataFrame, threshold: float) -> DataFrame:
    """The shingles of each item's sketch: item, size, h."""
    frequency = found.groupBy("size", "h").agg(F.count(F.lit(1)).alias("frequency"))
    upper = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n") + 0.0)) + 1) - 1
    # 1e-9: (1 - 0.8) * 15 is a little more than 3 in doubles on some and less on other machines.
    most = F.floor((1 - threshold) * upper + 1e-9) + 1
    order = Window.partitionBy("item").orderBy("frequency", "h", "shingle")
    placed = found.join(frequency, ["size", "h"]).withColumn("place", F.row_number().over(order))
    return placed.filter(F.col("place") <= most).select("item", "size", "h")


def contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """Pairs at or above the threshold: doc_id, item_id, n_shared, n_shingles, containment."""
    found = stored(item_shingles(items, item_id, item_text), "items")
    probes = stored(sketches(found, threshold), "sketches")
    sizes = [r["size"] for r in probes.select("size").distinct().collect()]
    rows = picked(docs, (doc_id, "doc_id"), (text, "text"))
    worded = rows.select("doc_id", words(F.col("text")).alias("words"))
    small = is_small(probes, broadcast_rows)
    pairs = None
    for size in sizes or [SHINGLE]:
        part = probes.filter(F.col("size") == size).select("item", "h")
        part = shingles(worded, size, "doc_id").select("doc_id", "h").join(F.broadcast(part) if small else part, "h").select("doc_id", "item")
        pairs = part if pairs is None else pairs.unionByName(part)
    pairs = stored(pairs.distinct(), "candidates")
    some = stored(pairs.select(F.col("doc_id").alias("candidate")).distinct(), "candidate_docs")
    chosen = joined(worded, some, F.col("doc_id").eqNullSafe(F.col("candidate")), "left_semi", broadcast_rows)
    small = is_small(found, broadcast_rows)
    shared = None
    for size in sizes or [SHINGLE]:
        part = found.filter(F.col("size") == size).select("item", "h", "shingle", "n", "item_id")
        part = shingles(chosen, size, "doc_id").join(F.broadcast(part) if small else part, ["h", "shingle"])
        shared = part if shared is None else shared.unionByName(part)
    pairs = pairs.withColumnsRenamed({"doc_id": "pair_doc", "item": "pair_item"})
    shared = shared.select("doc_id", "item", "item_id", "n", "shingle").distinct()
    shared = shared.groupBy("doc_id", "item", "item_id", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    shared = shared.join(pairs, F.col("doc_id").eqNullSafe(F.col("pair_doc")) & (F.col("item") == F.col("pair_item")), "left_semi")
    containment = F.col("n_shared") / F.col("n")
    return shared.filter(containment >= threshold).select(
        "doc_id", "item_id", "n_shared", F.col("n").alias("n_shingles"), containment.alias("containment")
    )


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that contain no item, with all their columns."""
    hits = contamination(docs, items, threshold, doc_id, text, item_id, item_text)
    hits = stored(hits.select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return joined(docs, hits, docs[doc_id].eqNullSafe(hits["_leak"]), "left_anti")
