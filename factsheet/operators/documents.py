"""Documents: overlapping chunks, question/answer pairs, units to embed, metadata.

Every operator is a narrow, row-local transformation: a document never leaves its task,
and there is no shuffle between reading a document and its units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsheet.functions.columns import require
from factsheet.functions.folds import accumulator, fold_emit
from factsheet.functions.text import SPACE_CLASS, STORED_TEXT_LIMIT, stored_text, strip

CHUNK_SIZE = 1000
OVERLAP = 200

# The markers of the question/answer document format.
QUESTION = r"(?sd)Q\p{Nd}+:" + SPACE_CLASS + r"*(.+?)(?=\n\nAns:|$)"
ANSWER = r"(?sd)Ans:" + SPACE_CLASS + r"*(.+?)(?=\n\nANALYSIS:|Q\p{Nd}+:|$)"
ANALYSIS = r"(?sd)ANALYSIS:" + SPACE_CLASS + r"*(.+?)(?=Q\p{Nd}+:|$)"

UNIT_FIELDS = ("chunk_type", "chunk", "question_part", "answer_part", "analysis_part")


def _paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda p: p != "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+", -1), lambda w: w != "")


def _chunks(paragraphs: Column, chunk_size: int, overlap: int) -> Column:
    """Fold paragraphs into chunks; ``paragraphs`` must be a plain column, not an expression."""
    if chunk_size <= 0:
        raise ValueError("chunk_size must be positive")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    kept = -(-overlap // 5)
    none = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        chunk = acc["s"]
        full = (chunk != "") & (F.length(chunk) + F.length(p) > chunk_size)
        opened = p
        if kept:
            tail = F.reverse(F.slice(F.reverse(_words(chunk)), 1, kept))
            opened = F.concat(F.concat_ws(" ", tail), F.lit(" "), p)
        return (
            F.when(full, accumulator(opened, F.concat(acc["o"], F.array(chunk))))
            .when(chunk == "", accumulator(p, acc["o"]))
            .otherwise(accumulator(F.concat(chunk, F.lit("\n"), p), acc["o"]))
        )

    def finish(chunk: Column) -> Column:
        return F.when(chunk != "", F.array(chunk)).otherwise(none)

    return fold_emit(paragraphs, F.lit(""), "string", step, finish)


def _with_chunks(df: DataFrame, text: str, chunk_size: int, overlap: int) -> DataFrame:
    # Two references to _paragraphs keep it a column of its own instead of being inlined.
    split = df.withColumn("_paragraphs", _paragraphs(F.coalesce(F.col(text), F.lit(""))))
    return split.withColumn("_chunks", _chunks(F.col("_paragraphs"), chunk_size, overlap)).drop("_paragraphs")


def _with_segments(df: DataFrame, text: str) -> DataFrame:
    """Add ``_questions`` (whole question matches) and ``_segments`` (each up to the next one)."""
    t = F.coalesce(F.col(text), F.lit(""))
    has = t.rlike(r"Q\p{Nd}+:")
    none = F.array().cast("array<string>")
    found = df.withColumn(
        "_questions", F.when(has, F.regexp_extract_all(t, F.lit(QUESTION), F.lit(0))).otherwise(none)
    ).withColumn("_gaps", F.when(has, F.split(t, QUESTION, -1)).otherwise(F.array(t)))
    return found.withColumn(
        "_segments",
        F.zip_with("_questions", F.slice("_gaps", 2, F.greatest(F.size("_questions"), F.lit(1))), lambda q, g: F.concat(q, g)),
    ).drop("_gaps")


def _next_with(segments: Column, marker: str) -> Column:
    """For each segment the index of the first segment from there on that holds the marker."""

    def step(acc: Column, i: Column) -> Column:
        at = F.when(F.get(segments, i).contains(marker), i).otherwise(acc["s"])
        return accumulator(at, F.concat(acc["o"], F.array(at)))

    backwards = F.reverse(F.sequence(F.lit(0), F.size(segments) - 1))
    found = F.reverse(fold_emit(backwards, F.lit(None).cast("int"), "int", step))
    return F.when(F.size(segments) > 0, found).otherwise(F.array().cast("array<int>"))


def _part(segments: Column, index: Column) -> Column:
    """A segment and the one after it: a match that starts in the first ends within both."""
    return F.concat(F.get(segments, index), F.coalesce(F.get(segments, index + 1), F.lit("")))


def _with_pairs(df: DataFrame, text: str) -> DataFrame:
    """Add ``_pairs``: per question its match and the text its answer and analysis come from.

    A question without an answer of its own takes the next one in the document.
    """
    found = _with_segments(df, text)
    s = F.col("_segments")
    indexed = found.withColumn("_answer_at", _next_with(s, "Ans:")).withColumn(
        "_analysis_at", _next_with(s, "ANALYSIS:")
    )
    pairs = F.transform(
        F.col("_questions"),
        lambda q, i: F.struct(
            F.lit("qa_pair").alias("chunk_type"),
            F.lit(None).cast("string").alias("chunk"),
            q.alias("question_part"),
            _part(s, F.get("_answer_at", i)).alias("answer_part"),
            _part(s, F.get("_analysis_at", i)).alias("analysis_part"),
        ),
    )
    return indexed.withColumn("_pairs", pairs).drop("_questions", "_segments", "_answer_at", "_analysis_at")


def _exploded(df: DataFrame, doc_id: str, index: str, name: str, items: Column) -> DataFrame:
    """Explode after the fact of emptiness: the inner form makes the optimizer evaluate
    the whole array expression again in a filter below the generator."""
    return df.select(doc_id, F.posexplode_outer(items).alias(index, name)).filter(F.col(index).isNotNull())


def _qa_columns() -> list[Column]:
    def part(c: str, pattern: str) -> Column:
        return F.coalesce(strip(F.regexp_extract(F.col(c), pattern, 1)), F.lit(""))

    return [
        part("question_part", QUESTION).alias("question"),
        part("answer_part", ANSWER).alias("answer"),
        part("analysis_part", ANALYSIS).alias("analysis"),
    ]


def chunk_text(
    df: DataFrame, doc_id: str = "file_id", text: str = "text", chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, chunk_idx, chunk): paragraphs folded into chunks of about ``chunk_size`` characters.

    A chunk that would grow beyond the size is closed, and the next one starts with the last
    ``overlap / 5`` words of it. A paragraph is never split.
    """
    require(df, doc_id, text)
    folded = _with_chunks(df.select(doc_id, text), text, chunk_size, overlap)
    return _exploded(folded, doc_id, "chunk_idx", "chunk", F.col("_chunks"))


def extract_qa(df: DataFrame, doc_id: str = "file_id", text: str = "text") -> DataFrame:
    """(doc_id, qa_idx, question, answer, analysis) of every ``Q<number>:`` in the text."""
    require(df, doc_id, text)
    found = _with_pairs(df.select(doc_id, text), text)
    rows = _exploded(found, doc_id, "qa_idx", "p", F.col("_pairs")).select(doc_id, "qa_idx", "p.*")
    return rows.select(doc_id, "qa_idx", *_qa_columns())


# The labels of a pair's text.
QUESTION_LABEL, ANSWER_LABEL, ANALYSIS_LABEL = "Question: ", "Answer: ", "Analysis: "


def qa_text(question: Column, answer: Column, analysis: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit(QUESTION_LABEL), question),
        F.concat(F.lit(ANSWER_LABEL), answer),
        F.when(analysis != "", F.concat(F.lit(ANALYSIS_LABEL), analysis)),
    )


def document_units(
    df: DataFrame,
    doc_id: str = "file_id",
    text: str = "text",
    chunk_size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    stored: int | None = STORED_TEXT_LIMIT,
) -> DataFrame:
    """The units of a document that get a vector: its chunks, then its question/answer pairs.

    ``full_text`` is what is embedded, ``original_text`` the first ``stored`` characters (None: all) kept
    for display.
    """
    require(df, doc_id, text)
    folded = _with_pairs(_with_chunks(df.select(doc_id, text), text, chunk_size, overlap), text)
    empty = F.lit(None).cast("string")
    chunks = F.transform(
        "_chunks",
        lambda c: F.struct(
            F.lit("text").alias("chunk_type"),
            c.alias("chunk"),
            *[empty.alias(n) for n in UNIT_FIELDS[2:]],
        ),
    )
    units = _exploded(folded, doc_id, "chunk_idx", "u", F.concat(chunks, "_pairs"))
    rows = units.select(doc_id, "chunk_idx", "u.*").select(doc_id, "chunk_idx", "chunk_type", "chunk", *_qa_columns())
    pair = F.col("chunk_type") == "qa_pair"
    full = F.when(pair, qa_text(F.col("question"), F.col("answer"), F.col("analysis"))).otherwise(F.col("chunk"))
    return rows.select(
        doc_id,
        "chunk_idx",
        "chunk_type",
        full.alias("full_text"),
        stored_text(full, stored).alias("original_text"),
        F.when(pair, F.col("question")).alias("question_text"),
        F.when(pair, F.col("answer")).alias("answer_text"),
        F.when(pair, F.col("analysis")).alias("analysis_text"),
    )


def document_metadata(
    df: DataFrame,
    doc_id: str = "file_id",
    text: str = "text",
    chunk_size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Per document: characters, chunks, question/answer pairs; other columns are kept."""
    require(df, doc_id, text)
    folded = _with_segments(_with_chunks(df, text, chunk_size, overlap), text)
    rest = [c for c in df.columns if c not in (doc_id, text)]
    return folded.select(
        doc_id,
        *rest,
        F.length(F.coalesce(text, F.lit(""))).cast("bigint").alias("num_characters"),
        F.size("_chunks").alias("num_chunks"),
        F.size("_questions").alias("num_qa_pairs"),
        (F.size("_questions") > 0).alias("has_questions"),
    )
