"""Exact medians of any number of columns in two scans.

The first scan makes a mergeable quantile sketch of every column, and reads from each a bracket that should
hold the middle rank. The second counts, for all columns at once, what lies below the bracket and every value
inside it; the counts say exactly which value has the middle rank, or that the bracket missed it and a wider
one, known from the same sketch, is counted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from factsheet.functions.columns import measure
from factsheet.functions.session import staged

#: Rows strictly inside brackets that are listed; more are counted in ranges of a stored table.
SMALL = 1 << 16
#: Size of a sketch; its ranks are off by about 0.1 % of the rows.
SKETCH = 4096
#: Shares of the rows on either side of the middle that brackets hold; the last holds everything.
MARGINS = (0.002, 0.02, 0.5)
_TASK_BITS = 33


def medians(df: DataFrame, columns: Sequence[str], small: int = SMALL) -> dict[str, float | None]:
    """The exact median of each column."""
    return figures(df, columns, small=small)[1]


def figures(df: DataFrame, columns: Sequence[str], extra: Sequence[Column] = (), small: int = SMALL) -> tuple[Row | None, dict[str, float | None]]:
    """Further aggregates of the same first scan, and the exact median of each column."""
    v = [measure(df, c).cast("double") for c in columns]
    if not columns:
        return (df.agg(*extra).first() if extra else None), {}
    sketched = df.agg(
        *extra,
        *[f.alias(f"_{label}{i}") for i, x in enumerate(v) for label, f in (("n", F.count(x)), ("s", F.kll_sketch_agg_double(x, F.lit(SKETCH))))],
    )
    shares = F.array(*[F.lit(0.5 + m) for w in MARGINS for m in (-w, w)])
    ends = [F.when(F.col(f"_n{i}") > 0, F.kll_sketch_get_quantile_double(f"_s{i}", shares)).alias(f"_e{i}") for i in range(len(v))]
    # ``extra`` keeps its place at the start of the row.
    facts = sketched.select(*[c for c in sketched.columns if not c.startswith("_s")], *ends).first()
    counts = {i: facts[f"_n{i}"] for i in range(len(v)) if facts[f"_n{i}"]}
    brackets = {i: [tuple(facts[f"_e{i}"][2 * m : 2 * m + 2]) for m in range(len(MARGINS))] for i in counts}
    pending = {(i, k) for i, n in counts.items() for k in ((n - 1) // 2, n // 2)}
    found: dict[tuple[int, int], float] = {}
    for margin in range(len(MARGINS)):
        if pending:
            wanted = {i: sorted(k for j, k in pending if j == i) for i, _ in pending}
            many = 2 * MARGINS[margin] * sum(counts[i] for i in wanted) > small
            found |= _counted(df, {i: v[i] for i in wanted}, {i: brackets[i][margin] for i in wanted}, wanted, many)
            pending -= found.keys()
    answer: dict[str, float | None] = {}
    for i, c in enumerate(columns):
        if i not in counts:
            answer[c] = None
            continue
        low, high = found[i, (counts[i] - 1) // 2], found[i, counts[i] // 2]
        answer[c] = low if low == high else low / 2 + high / 2 if math.isinf(low + high) else (low + high) / 2
    return facts, answer


def _counted(df: DataFrame, v: dict[int, Column], brackets: dict[int, tuple[float, float]], ranks: dict[int, list[int]], many: bool) -> dict[tuple[int, int], float]:
    """The values of the wanted ranks that lie in their bracket, from one scan of all columns."""
    return _in_ranges(_long(df, v, brackets), ranks) if many else _listed(df, v, brackets, ranks)


def _listed(df: DataFrame, v: dict[int, Column], brackets: dict[int, tuple[float, float]], ranks: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """From brackets of few rows: both ends are counted, however many rows hold them, and what lies between is listed."""
    aggregates = []
    for i, x in v.items():
        low, high = (F.lit(e).cast("double") for e in brackets[i])
        between = F.collect_list(F.when((x > low) & (x < high), x))
        aggregates += [F.count_if(x < low).alias(f"p{i}"), F.count_if(x == low).alias(f"l{i}"), F.count_if((x == high) & (x > low)).alias(f"h{i}"), between.alias(f"b{i}")]
    row = df.agg(*aggregates).first()
    found = {}
    for i, wanted in ranks.items():
        low, high = brackets[i]
        inside = sorted(row[f"b{i}"])
        for k in wanted:
            at = k - row[f"p{i}"] - row[f"l{i}"]
            if -row[f"l{i}"] <= at < len(inside) + row[f"h{i}"]:
                found[i, k] = low if at < 0 else inside[at] if at < len(inside) else high
    return found


def _long(df: DataFrame, v: dict[int, Column], brackets: dict[int, tuple[float, float]]) -> DataFrame:
    """(c, below, x, n): the distinct values in each column's bracket, and how many rows are below it."""
    cells = []
    for i, x in v.items():
        low, high = (F.lit(e).cast("double") for e in brackets[i])
        # What is above the bracket isn't counted; what is below counts as one value.
        cells.append(F.when(x <= high, F.struct(F.lit(i).alias("c"), (x < low).alias("below"), F.when(x >= low, x).alias("x"))))
    long = df.select(F.explode(F.array_compact(F.array(*cells))).alias("e")).select("e.*")
    return long.groupBy("c", "below", "x").agg(F.count(F.lit(1)).alias("n"))


def _in_ranges(counts: DataFrame, ranks: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """From any number of distinct values: they are stored in ranges, and only the ranges of the ranks are looked at."""
    ranged = counts.repartitionByRange("c", F.desc("below"), "x").sortWithinPartitions("c", F.desc("below"), "x")
    stored = staged(ranged.withColumn("at", F.monotonically_increasing_id()), "values")
    task = F.shiftright("at", _TASK_BITS)
    # One row for each range and column.
    sizes = stored.groupBy("c", task.alias("task")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("below"), F.col("n")).otherwise(0)).alias("below")).collect()
    passed: dict[int, int] = dict.fromkeys(ranks, 0)
    targets = []
    for c, t, n, below in sorted(sizes):
        targets += [(c, t, k, k - passed[c]) for k in ranks[c] if passed[c] + below <= k < passed[c] + n]
        passed[c] += n
    if not targets:
        return {}
    # Two rows for each column.
    table = F.broadcast(counts.sparkSession.createDataFrame(targets, "c int, task bigint, rank bigint, k bigint"))
    end = F.sum("n").over(W.partitionBy("c", "task").orderBy("at"))
    near = stored.withColumn("task", task).join(table.select("c", "task").distinct(), ["c", "task"], "left_semi").withColumn("end", end)
    hits = near.join(table, ["c", "task"]).filter((F.col("k") < F.col("end")) & (F.col("k") >= F.col("end") - F.col("n")))
    return {(r.c, r["rank"]): r.x for r in hits.collect()}
