"""Records of CSV text with line breaks inside quotes, found in all splits of a file at once.

Whether a line starts inside quotes depends on all lines before it, but each line is a function of two
states: outside or inside at its start gives outside or inside at its end. So every split first reports where
it ends from either start; following these pairs through the few splits of a file says where each one starts;
then all splits cut their lines into records at the same time. Only a record that goes on into the next
split is put together from its parts afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsheet.functions.hashing import decoded
from factsheet.functions.session import staged

FILE, NAME, SPLIT, AT, RECORD = "_file", "_name", "_split", "_at", "_record"
#: A record that lies in one split; the last lines of a record from an earlier split; a record's first lines.
WHOLE, REST, START = 0, 1, 2


def lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All lines of the files with their file and split; a task has the lines of a split in order."""
    return spark.read.text(list(paths)).select(
        decoded(F.col("_metadata.file_path")).alias(FILE),
        decoded(F.col("_metadata.file_name")).alias(NAME),
        F.col("_metadata.file_block_start").alias(SPLIT),
        "value",
    )


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that starts inside or outside of quotes ends inside.

    A quote opens at the start of a field only, and closes unless it is doubled.
    """
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            at = line.find(",", at)
            if at < 0:
                return False
            at += 1
            inside = False
        if not line.startswith('"', at):
            at = line.find(',"', at) + 1
            if not at:
                return False
        at += 1
        inside = True


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """(file, split), first and end row of each stretch of one split in a batch."""
    if not batch.num_rows:
        return
    files, splits = batch.column(FILE).dictionary_encode(), batch.column(SPLIT).to_numpy()
    codes = files.indices.to_numpy()
    starts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (splits[1:] != splits[:-1])) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        yield (files.dictionary[int(codes[a])].as_py(), int(splits[a])), a, b


def _quoted(values: pa.Array) -> list[int]:
    return pc.indices_nonzero(pc.match_substring(values, '"')).to_pylist()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, state at its end from outside, and from inside) of each split of a task."""
    found: dict[tuple[str, int], tuple[bool, bool]] = {}
    for batch in batches:
        for split, a, b in _runs(batch):
            outside, inside = found.get(split, (False, True))
            values = batch.column("value").slice(a, b - a)
            for i in _quoted(values):
                line = values[i].as_py()
                same = outside == inside
                outside = ends_inside(line, outside)
                inside = outside if same else ends_inside(line, inside)
            found[split] = outside, inside
    if found:
        columns = [[k[0] for k in found], [k[1] for k in found], [v[0] for v in found.values()], [v[1] for v in found.values()]]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [FILE, SPLIT, "outside", "inside"])


def _starts(ends: DataFrame) -> DataFrame:
    """(file, split, start): whether each split starts inside quotes, following the splits of its file."""
    before = W.partitionBy(FILE).orderBy(SPLIT).rowsBetween(W.unboundedPreceding, -1)
    # A split that ends alike from both starts forgets what was before; from there on only changes count.
    fixed = F.col("outside") == F.col("inside")
    last = F.max(F.when(fixed, F.struct(SPLIT, "outside"))).over(before)
    turned = F.sum(F.when(~fixed & F.col("outside"), 1).otherwise(0)).over(before)
    marked = ends.select(FILE, SPLIT, "outside", "inside", last.alias("last"), F.coalesce(turned, F.lit(0)).alias("turned"))
    known = marked.select(F.col(FILE).alias("f"), F.col(SPLIT).alias("s"), "turned")
    joined = marked.join(known.withColumnRenamed("turned", "then"), (F.col(FILE) == F.col("f")) & (F.col(f"last.{SPLIT}") == F.col("s")), "left")
    turns = F.col("turned") - F.coalesce("then", F.lit(0))
    start = F.coalesce(F.col("last.outside"), F.lit(False)) != (turns % 2 == 1)
    return joined.select(FILE, SPLIT, start.alias("start"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each split of a task, numbered; what lies across a border is marked."""
    now, name, inside, rest, at = None, "", False, False, 0
    waiting: list[str] = []
    out: list[tuple] = []

    def put(kind: int) -> None:
        nonlocal at
        text = "\n".join(waiting)
        waiting.clear()
        # A blank line is no record.
        if kind != WHOLE or text.strip():
            out.append((*now[:1], name, now[1], at, kind, text))
            at += kind != REST

    def flush() -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, [FILE, NAME, SPLIT, AT, "kind", RECORD])

    def close() -> None:
        if now is not None and waiting:
            # What is left at the end of a split goes on in the next one, if there is one.
            put(REST if rest else START)

    for batch in batches:
        for split, a, b in _runs(batch):
            if split != now:
                close()
                now, name, at = split, batch.column(NAME)[a].as_py(), 0
                inside = rest = batch.column("start")[a].as_py()
            values = batch.column("value").slice(a, b - a)
            quoted = set(_quoted(values))
            for i, line in enumerate(values.to_pylist()):
                waiting.append(line)
                if i in quoted:
                    inside = ends_inside(line, inside)
                if not inside:
                    put(REST if rest else WHOLE)
                    rest = False
        if len(out) >= 10_000:
            yield flush()
    close()
    if out:
        yield flush()


def records(spark: SparkSession, paths: Sequence[str], only: DataFrame | None) -> DataFrame:
    """(file, name, split, at, record) of all records that aren't blank, numbered within the split they start in.

    ``only`` has the files to be read, if not all; it is broadcast, as lines must keep their order, and has
    one row for each file.
    """
    text = lines(spark, paths)
    if only is not None:
        text = text.join(F.broadcast(only), FILE, "left_semi")
    ends = staged(text.mapInArrow(_ends, f"{FILE} string, {SPLIT} bigint, outside boolean, inside boolean"), "ends")
    # One row for each split, some megabytes of text.
    starts = F.broadcast(staged(_starts(ends), "starts"))
    lost = F.raise_error("a file changed while it was read").cast("boolean")
    known = text.join(starts, [FILE, SPLIT], "left").withColumn("start", F.coalesce("start", lost))
    schema = f"{FILE} string, {NAME} string, {SPLIT} bigint, {AT} bigint, kind int, {RECORD} string"
    cut = staged(known.mapInArrow(_cut, schema), "records")
    # At most two parts a split; the parts of a record follow its start.
    order = W.partitionBy(FILE).orderBy(SPLIT, "kind")
    parts = cut.filter(F.col("kind") != WHOLE).withColumn("n", F.sum((F.col("kind") == START).cast("int")).over(order))
    place = F.struct(SPLIT, "kind", RECORD)
    first = F.min_by(F.struct(SPLIT, AT), F.when(F.col("kind") == START, F.col(SPLIT)))
    whole = parts.groupBy(FILE, NAME, "n").agg(first.alias("first"), F.array_sort(F.collect_list(place)).alias("parts"))
    joined = whole.select(FILE, NAME, F.col(f"first.{SPLIT}").alias(SPLIT), F.col(f"first.{AT}").alias(AT), F.array_join(F.col(f"parts.{RECORD}"), "\n").alias(RECORD))
    return cut.filter(F.col("kind") == WHOLE).select(FILE, NAME, SPLIT, AT, RECORD).unionByName(joined)
