"""Connected components of a pair table, by joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsheet.llm.common import is_small, stored


def components(pairs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(node, root) of each node in (a, b): the least node of its component.

    Each round takes the least root among a node and its neighbours, then the root's root. Rounds end
    when nothing changes; star-like groups need two or three. Every round's labels are written to the
    shared folder, and only a digest of them reaches the driver. Labels are broadcast up to a checked
    number of pairs and joined by a shuffle beyond it.
    """
    ends = pairs.select("a", "b").union(pairs.select("b", "a"))
    both = stored(ends.union(ends.select("a", F.col("a").alias("b"))).distinct(), "pairs")
    small = is_small(both, broadcast_rows)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "labels")
    state = None
    while True:
        now = labels.agg(F.bit_xor(F.xxhash64("node", "root")).alias("x")).first()["x"]
        if now == state:
            return labels
        state = now
        side = F.broadcast(labels) if small else labels
        near = both.join(side, both["b"] == side["node"]).groupBy("a").agg(F.min("root").alias("hook"))
        top = side.select(F.col("node").alias("hook"), F.col("root").alias("top"))
        labels = stored(near.join(top, "hook").select(F.col("a").alias("node"), F.least("hook", "top").alias("root")), "labels")
