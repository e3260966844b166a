"""Sharding by jump consistent hashing, on DataFrame functions only.

A row's keys are hashed once (XXH64, seed 42, of their texts), and that number alone decides, with the
number of shards, where the row goes: the generator it seeds jumps forward through the shard numbers, and
the last jump that stays below the number of shards is the shard. There is no table of ranges or ring
points to keep, any reader can compute the shard of a key, and one more shard takes 1/n of the rows, all
of them into itself.

Rows move once, whole: dealt by shard, where adaptive execution cuts a shard that is large (all rows
of one key, say) into as many tasks as its bytes need, and sorted by shard and keys inside a task. Each
task numbers its rows as it writes them, so a task that is run again commits one numbering. A slot is
that number less the task's first in the shard, plus the shard's rows in earlier tasks: a table of one row
for each file.

Defined cases: null keys count as keys of their own, and rows of equal keys share a shard, whatever
they hold; null text has no bytes, so its size is the overhead alone and its checksum 0; equal rows are
rows of their own with slots of their own; very long texts are cells like others; an empty table gives
empty shards. The columns of the table travel inside the struct ``row``, so none can clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsheet.llm.common import joined, shared_path
from factsheet.llm.quality import let

#: Bytes that a row counts beside its text.
OVERHEAD = 8
#: Rows that a task can number: the bits below the task's own number in monotonically_increasing_id.
TASK_BITS = 33
# Fixed value: the multiplier of the published generator; the state has 64 bits, a jump uses the upper 31.
MULTIPLIER = Decimal(2862933555777941757)
STATE = Decimal(1 << 64)
UPPER = Decimal(1 << 33)
#: Jumps that every row makes; about ln(shards) + 1 are needed, rows that need more make them.
JUMPS = 32


def key_hash(*keys: Column) -> Column:
    """The number from 0 to 2^64 - 1 that stands for a row's keys, as a decimal."""
    texts = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("")) for k in keys]
    h = F.xxhash64(F.concat_ws("\x00", *texts)).cast("decimal(20,0)")
    return F.when(h < 0, h + STATE).otherwise(h).cast("decimal(20,0)")


def jump(key: Column, shards: int, more: int = 0) -> Column:
    """struct(shard, grown): where a key goes among ``shards`` shards and among ``more`` further ones.

    The jumps don't depend on the number of shards, so one walk answers both.
    """
    if shards < 1 or more < 0:
        raise ValueError("there must be a shard")
    total = shards + more

    def step(state: Column, _) -> Column:
        seed = ((state["key"] * MULTIPLIER + Decimal(1)) % STATE).cast("decimal(20,0)")
        upper = F.floor(seed / UPPER).cast("double") + 1
        ahead = F.floor((state["at"] + 1).cast("double") * (float(1 << 31) / upper)).cast("bigint")
        moved = F.struct(
            seed.alias("key"),
            ahead.alias("at"),
            F.when(ahead < shards, ahead).otherwise(state["shard"]).alias("shard"),
            F.when(ahead < total, ahead).otherwise(state["grown"]).alias("grown"),
        )
        return F.when(state["at"] < total, moved).otherwise(state)

    zero = F.lit(0).cast("bigint")
    start = F.struct(key.cast("decimal(20,0)").alias("key"), zero.alias("at"), zero.alias("shard"), zero.alias("grown"))
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(min(JUMPS, total))), start, step)

    def rest(state: Column) -> Column:
        left = F.when(state["at"] < total, F.sequence(F.lit(0), F.lit(total))).otherwise(F.array().cast("array<int>"))
        end = F.aggregate(left, state, step) if total > JUMPS else state
        return let(end, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))

    return let(walked, rest)


def write_shards(docs: DataFrame, path: str, shards: int, keys: Sequence[str] = ("doc_id",), text: str = "text", more: int = 1) -> None:
    """Write every row of a table into the folder of its shard, and the table of slots beside them.

    Below ``rows`` there is a folder for each shard; each row has ``row`` (all columns of the table),
    ``size``, ``grown`` (its shard if there were ``more`` shards more) and ``at``.
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    hashed = key_hash(*[F.col(f"`{k}`") for k in keys])
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("bigint") + OVERHEAD
    rows = docs.select(row.alias("row"), size.alias("size"), hashed.alias("key"))
    # The scan position orders rows of one key; whatever they hold, they are told apart by it.
    rows = rows.withColumns({"place": jump(F.col("key"), shards, more), "scanned": F.monotonically_increasing_id()})
    dealt = rows.select("row", "size", "key", "scanned", F.col("place.shard").alias("shard"), F.col("place.grown").alias("grown")).hint("rebalance", F.col("shard"))
    numbered = dealt.sortWithinPartitions("shard", "key", "scanned").withColumn("at", F.monotonically_increasing_id())
    numbered.drop("key", "scanned").write.partitionBy("shard").parquet(f"{path}/rows")
    written = _rows(spark, path, docs, ["shard", "at"])
    task = F.shiftright("at", TASK_BITS)
    counts = written.groupBy("shard", task.alias("task")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    counts.withColumn("before", F.coalesce(before, F.lit(0))).write.parquet(f"{path}/slots")


def _rows(spark: SparkSession, path: str, like: DataFrame, columns: Sequence[str]) -> DataFrame:
    kinds = {"row": like.schema, "size": T.LongType(), "grown": T.IntegerType(), "at": T.LongType(), "shard": T.IntegerType()}
    schema = T.StructType([T.StructField(c, kind) for c, kind in kinds.items()])
    return spark.read.schema(schema).parquet(f"{path}/rows").select(*columns)


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """(row, size, shard, slot, grown) of all rows that ``write_shards`` wrote for a table such as ``like``.

    A filter on ``shard`` opens that shard's folder alone.
    """
    rows = _rows(spark, path, like, ["row", "size", "grown", "at", "shard"]).withColumn("task", F.shiftright("at", TASK_BITS))
    slots = spark.read.schema("shard int, task bigint, first bigint, n bigint, before bigint").parquet(f"{path}/slots")
    # One row for each file: broadcast up to a checked number, joined by a shuffle beyond it.
    placed = joined(rows, slots.select("shard", "task", "first", "before"), ["shard", "task"])
    return placed.select("row", "size", "shard", (F.col("at") - F.col("first") + F.col("before")).alias("slot"), "grown")


def sharded(docs: DataFrame, shards: int, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``read_shards`` of a table written to the shared folder."""
    path = shared_path(docs.sparkSession, "shards")
    write_shards(docs, path, shards, keys, text)
    return read_shards(docs.sparkSession, path, docs)
