"""Row-local sequential folds over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_BLOCK = 256


def fold_emit(
    items: Column,
    state: Column,
    emitted_type: str,
    step: Callable[[Column, Column], Column],
    finish: Callable[[Column], Column] | None = None,
) -> Column:
    """Walk an array with a state; each step may emit items. Returns all emitted items.

    ``step(acc, item)`` maps the accumulator (a struct of the state ``s`` and the items
    emitted so far in this block ``o``) to the next one; ``finish(s)`` gives the items
    emitted at the end. Items are gathered per block (256, or the square root of a long
    array) and the blocks are appended to the result: neither the array nor the result is
    copied at every step.
    """
    size = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt(F.size(items))).cast("int"))
    none = F.array().cast(f"array<{emitted_type}>")

    def block(acc: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(items, i * size + 1, size), accumulator(acc["s"], none), step)
        # A one-element transform binds the inner result, so that it is computed once.
        joined = F.transform(F.array(inner), lambda r: accumulator(r["s"], F.concat(acc["o"], r["o"])))
        return F.get(joined, F.lit(0))

    def end(acc: Column) -> Column:
        return acc["o"] if finish is None else F.concat(acc["o"], finish(acc["s"]))

    blocks = F.sequence(F.lit(0), F.floor(F.size(items) / size).cast("int"))
    return F.aggregate(blocks, accumulator(state, none), block, end)


def accumulator(state: Column, emitted: Column) -> Column:
    return F.struct(state.alias("s"), emitted.alias("o"))
