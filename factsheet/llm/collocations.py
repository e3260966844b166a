"""Collocations: phrases of two to four words that keep together, scored with exact whole numbers.

Only the longest windows are counted. A word and its followers, as far as the piece of text goes, make
one window of four columns (words shifted against each other, so the columns are leads), padded where the
piece ends. Equal windows become one row with a count. Every shorter phrase is a prefix of the window that
starts at its first word, so a ROLLUP over the window's columns sums the counts of successively shorter
prefixes down to single words and to the language's number of words; nothing shorter is ever exploded.

A window is cut before a word pair that occurs fewer than ``least`` times: no phrase over that pair can be
a candidate, nor part of one, so what is cut changes no count that is used. The pairs are told apart by
64-bit digests counted over all texts (two pairs of one digest only spare a cut). Frequent digests are
broadcast up to ``cut_rows`` of them, a proven bound; if there are more, windows simply stay whole.

Defined cases: null texts are empty, null languages ``und``; copies and repeated rows count each time;
words compare by their code points after lower-casing A-Z; an empty table gives an empty result; very
long texts are arrays of their words in one row; equal scores are ordered by count and phrase; only the two
named columns are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsheet.llm.common import picked, stored

#: Words of the longest phrase.
LONGEST = 4
COLUMNS = [f"w{k}" for k in range(1, LONGEST + 1)]
#: What ends a piece of text, and white space between words.
ENDS = ".,;:!?\n\x0b\x0c\r"
#: Scores are shares of the two parts' mean count, in millionths.
SCALE = 2_000_000
#: A candidate inside a longer one goes if the longer one has so many hundredths of its count.
COVERED = 80
CUT_ROWS = 1 << 21


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, words): all words of each text in order, with a lone "." wherever a piece ends."""
    rows = picked(docs, (text, "text"), (lang, "lang"))
    one = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase + ENDS + "\t", string.ascii_lowercase + "." * len(ENDS) + " ")
    split = F.split(F.replace(one, F.lit("."), F.lit(" . ")), " ")
    return rows.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.array_remove(split, "").alias("words"))


def leads(rows: DataFrame, n: int) -> DataFrame:
    """(lang, w1 ... wn): each word with its followers in the text."""
    size = F.size("words")
    shifted = [F.slice("words", k + 1, F.greatest(size - k, F.lit(0))).alias(f"w{k + 1}") for k in range(n)]
    return rows.select("lang", F.inline(F.arrays_zip(*shifted))).filter("w1 != '.'")


def inside(word: str) -> Column:
    return F.col(word).isNotNull() & (F.col(word) != ".")


def pair(a: str, b: str) -> Column:
    return F.xxhash64("lang", a, b)


def frequent_pairs(rows: DataFrame, least: int) -> DataFrame:
    """Digests of the word pairs that occur at least so often."""
    pairs = leads(rows, 2).filter(inside("w2")).select(pair("w1", "w2").alias("pair"))
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("pair")


def windows(rows: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """(lang, window): the longest window of each word, its words joined by spaces."""
    out = leads(rows, LONGEST)
    whole = F.lit(True)
    for k in range(1, LONGEST):
        a, b = COLUMNS[k - 1], COLUMNS[k]
        whole = whole & inside(b)
        if cuts is not None:
            kept = F.broadcast(cuts.select(F.col("pair").alias(f"pair{k}"), F.lit(True).alias(f"kept{k}")))
            out = out.join(kept, F.when(whole, pair(a, b)) == F.col(f"pair{k}"), "left")
            whole = whole & F.col(f"kept{k}").isNotNull()
        out = out.withColumn(f"whole{k}", F.coalesce(whole, F.lit(False)))
        whole = F.col(f"whole{k}")
    held = [F.when(F.col(f"whole{k}"), F.col(w)) for k, w in enumerate(COLUMNS[1:], 1)]
    return out.select("lang", F.concat_ws(" ", "w1", *held).alias("window"))


def counted_windows(found: DataFrame) -> DataFrame:
    """(lang, w1 ... w4, f): each distinct window, padded with empty words, and how often it occurs.

    A window is one string while it is shuffled, which takes less room than four.
    """
    counts = found.groupBy("lang", "window").agg(F.count(F.lit(1)).alias("f")).withColumn("words", F.split("window", " "))
    return counts.select("lang", *[F.coalesce(F.get("words", F.lit(k)), F.lit("")).alias(w) for k, w in enumerate(COLUMNS)], "f")


def phrases(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang", cut_rows: int = CUT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of at most four words that occur so often, and (lang, n) of all words."""
    rows = pieces(docs, text, lang)
    cuts = stored(frequent_pairs(rows, least), "pairs")
    whole = windows(rows, cuts if cuts.limit(cut_rows + 1).count() <= cut_rows else None)
    counted = stored(counted_windows(whole), "windows")
    shorter = COLUMNS[:-1]
    # The levels of the rollup: 0 has three words, 1 two, 3 one, 7 the language alone, 15 everything.
    level = F.grouping_id().alias("level")
    rolled = counted.rollup("lang", *shorter).agg(level, F.sum("f").alias("f"))
    words = F.greatest(F.lit(len(shorter)) - F.bit_count("level"), F.lit(0))
    last = F.element_at(F.array(F.lit("no pad"), *shorter), words + 1)
    rolled = stored(rolled.filter((F.col("level") < 15) & (last != "") & ((F.col("f") >= least) | (F.col("level") == 7))), "prefixes")
    longest = counted.filter((F.col(COLUMNS[-1]) != "") & (F.col("f") >= least))
    text_of = F.concat_ws(" ", *[F.col(w) for w in shorter])
    found = rolled.filter("level < 7").select("lang", text_of.alias("phrase"), words.cast("int").alias("k"), "f")
    found = found.unionByName(longest.select("lang", F.concat_ws(" ", *COLUMNS).alias("phrase"), F.lit(LONGEST).alias("k"), "f"))
    return stored(found, "phrases"), rolled.filter("level = 7").select("lang", F.col("f").alias("n"))


def parts(phrase: Column, start, n) -> Column:
    """``n`` words of a phrase from word ``start`` on, counted from 1."""
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score): every candidate with the cut that scores lowest."""
    candidates = found.filter("k >= 2").withColumnRenamed("f", "a")
    cut = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.withColumns({"first": parts(F.col("phrase"), F.lit(1), F.col("cut")), "rest": parts(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut"))})
    left = found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cut = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    # At most SCALE / 2, as no part is rarer than the whole.
    score = F.expr(f"cast(a as decimal(20,0)) * {SCALE} div (cast(l as decimal(20,0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("lowest")
    return cut.groupBy("lang", "phrase", "k", "a").agg(lowest).select("lang", "phrase", "k", "a", "lowest.l", "lowest.r", "lowest.score")


def covered(found: DataFrame) -> DataFrame:
    """(lang, phrase, longest): the greatest count of a longer candidate around each phrase of two words or more."""
    longer = found.filter(F.col("k") > 2)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: parts(F.col("phrase"), i, n))))
    return longer.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, least: int = 30, first: int = 2000, text: str = "text", lang: str = "lang", cut_rows: int = CUT_ROWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` best phrases of each language."""
    found, totals = phrases(docs, least, text, lang, cut_rows)
    hidden = F.coalesce(F.col("longest").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * COVERED, F.lit(False))
    kept = scored(found).join(covered(found), ["lang", "phrase"], "left").filter(~hidden)
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= first)
    # One row a language.
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
