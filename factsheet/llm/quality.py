"""Quality rules with adaptive thresholds, on DataFrame functions only.

Counts of each text are row-local array expressions. Their ratios go into KLL quantile sketches per
language and source; sketches merge into one per language and one of all, which serve groups of fewer
than ``least_rows`` documents. A document fails when a ratio lies beyond its group's fence: the upper
quartile plus ``reach`` interquartile ranges, and at least a ratio's ``slack`` above the upper quartile
(or as far below the lower one), so that a group of equal values doesn't reject the next larger one.

Defined cases: null text has no words and fails the base rules; null language and source are groups
of their own; equal rows get equal verdicts; an empty table gives an empty result; no column but the
four named ones is read. Sketches of at most ``SKETCH`` values are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsheet.llm.common import joined, picked, stored

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SKETCH = 4096
#: Ratio, least distance from the quartile, whether a low value fails too.
RATIOS = {
    "symbol_ratio": (0.04, False),
    "duplicate_ratio": (0.3, False),
    "repeat_ratio": (0.15, False),
    "capital_ratio": (0.3, False),
    "word_length": (3.0, True),
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside use it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tail(values: Column) -> Column:
    return F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))


def front(values: Column) -> Column:
    return F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0)))


def covered(windows: Column) -> Column:
    """Positions that windows seen twice or more cover, from the windows' hashes in order."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = let(placed, lambda p: F.zip_with(tail(p), front(p), lambda a, b: F.when(a["h"] == b["h"], F.array(b["i"], a["i"]))))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    steps = let(starts, lambda s: F.zip_with(tail(s), front(s), lambda a, b: F.least(a - b, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(WINDOW), lambda total, step: total + step)


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts and ratios of each document."""
    rows = picked(docs, (doc_id, "doc_id"), (text, "text"), (lang, "lang"), (source, "source"))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    rows = rows.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split("text", SPACES), "").alias("words"),
        F.length(F.translate("text", SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_capitals"),
        lines.alias("lines"),
    )
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    rows = rows.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", "n_capitals",
        n.cast("bigint").alias("n_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    distinct = F.size(F.array_distinct("windows"))
    repeated = F.when(distinct < F.size("windows"), covered(F.col("windows"))).otherwise(0)
    rows = rows.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("bigint")).drop("windows")
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / chars).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("duplicate_ratio"),
        (F.col("n_repeat_words") / words).alias("repeat_ratio"),
        (F.col("n_capitals") / chars).alias("capital_ratio"),
        (F.col("word_chars") / words).alias("word_length"),
    )


def fences(measured: DataFrame, least_rows: int = 100, reach: float = 3.0) -> DataFrame:
    """Per language and source: n and, for each ratio, the lowest and highest value that passes."""
    sketches = measured.filter(~F.col("base_failed")).groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(r, F.lit(SKETCH)).alias(r) for r in RATIOS]
    )
    sketches = stored(sketches, "sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, F.lit(SKETCH)).alias(r) for r in RATIOS]]

    def bounds(level: str) -> list[Column]:
        out = [F.col("n").alias(f"{level}_n")]
        for ratio, (slack, both) in RATIOS.items():
            low = F.kll_sketch_get_quantile_double(F.col(ratio), F.lit(0.25).cast("double"))
            high = F.kll_sketch_get_quantile_double(F.col(ratio), F.lit(0.75).cast("double"))
            far = F.greatest(reach * (high - low), F.lit(slack))
            least = low - far if both else F.lit(None).cast("double")
            out.append(F.struct(least.alias("least"), (high + far).alias("most")).alias(f"{level}_{ratio}"))
        return out

    own = sketches.select("lang", "source", *bounds("own"))
    by_lang = sketches.groupBy("lang").agg(*merged).select(F.col("lang").alias("of_lang"), *bounds("lang"))
    of_all = sketches.agg(*merged).select(*bounds("all"))
    # A group of failures alone has no sketch: every group of the table still gets a row.
    groups = measured.select("lang", "source").distinct()
    found = (
        groups.join(own.withColumnsRenamed({"lang": "l", "source": "s"}), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
        .join(by_lang, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
        .withColumn("one", F.lit(1))
        .join(of_all.withColumn("one", F.lit(1)), "one", "left")
    )
    chosen = [
        F.when(F.col("own_n") >= least_rows, F.col(f"own_{r}")).when(F.col("lang_n") >= least_rows, F.col(f"lang_{r}")).otherwise(F.col(f"all_{r}")).alias(r)
        for r in RATIOS
    ]
    return found.select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), *chosen)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least_rows: int = 100, reach: float = 3.0) -> DataFrame:
    """The measures of each document with ``failed`` (names of ratios beyond their fence) and ``kept``."""
    measured = stored(measures(docs, doc_id, text, lang, source), "measures")
    limits = stored(fences(measured, least_rows, reach).withColumnsRenamed({r: f"{r}_fence" for r in RATIOS}), "fences")
    both = joined(measured, limits, F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source")), "left")

    def beyond(ratio: str) -> Column:
        fence, value = F.col(f"{ratio}_fence"), F.col(ratio)
        out = (value > fence["most"]) | F.coalesce(value < fence["least"], F.lit(False))
        return F.when(F.coalesce(out, F.lit(False)), F.lit(ratio))

    failed = F.array_compact(F.array(*map(beyond, RATIOS)))
    return both.select(*measured.columns, failed.alias("failed"), (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"))
