import pytest
from pyspark.sql import functions as F

from factsheet import chunk_text, document_metadata, document_units, extract_qa

SCHEMA = "file_id string, text string"


def chunks(spark, text, **kw):
    df = spark.createDataFrame([("d", text)], SCHEMA)
    return [r["chunk"] for r in chunk_text(df, **kw).orderBy("chunk_idx").collect()]


def pairs(spark, text):
    df = spark.createDataFrame([("d", text)], SCHEMA)
    return [tuple(r) for r in extract_qa(df).orderBy("qa_idx").select("question", "answer", "analysis").collect()]


def test_short_and_blank_texts(spark):
    assert chunks(spark, "") == [] and chunks(spark, None) == [] and chunks(spark, " \n\t\n") == []
    assert chunks(spark, "  a b \n\n c \n") == ["a b\nc"]


def test_chunks_overlap_by_words(spark):
    text = "\n".join(["one two three", "four five six", "seven"])
    assert chunks(spark, text, chunk_size=14, overlap=10) == [
        "one two three", "two three four five six", "five six seven",
    ]
    # The overlap in words is rounded up.
    assert chunks(spark, text, chunk_size=14, overlap=11)[1] == "one two three four five six"
    assert chunks(spark, text, chunk_size=14, overlap=0) == ["one two three", "four five six", "seven"]


def test_size_is_reached_not_passed(spark):
    assert chunks(spark, "abcde\nfghij", chunk_size=10) == ["abcde\nfghij"]
    assert chunks(spark, "abcde\nfghijk", chunk_size=10, overlap=0) == ["abcde", "fghijk"]


def test_long_paragraph_is_not_split(spark):
    assert chunks(spark, "x" * 5000 + "\ny", chunk_size=100, overlap=5) == ["x" * 5000, "x" * 5000 + " y"]


def test_characters_not_bytes_are_counted(spark):
    assert chunks(spark, "é" * 5 + "\n" + "漢" * 5, chunk_size=10) == ["é" * 5 + "\n" + "漢" * 5]


def test_unicode_space_separates_words(spark):
    assert chunks(spark, "a b　c\nd", chunk_size=5, overlap=10) == ["a b　c", "b c d"]


def test_many_paragraphs_cross_fold_blocks(spark):
    got = chunks(spark, "\n".join(f"p{i:04d}" for i in range(1500)), chunk_size=11, overlap=0)
    assert got == [f"p{i:04d}\np{i + 1:04d}" for i in range(0, 1500, 2)]


def test_chunk_arguments(spark):
    df = spark.createDataFrame([("d", "x")], SCHEMA)
    for kw in ({"chunk_size": 0}, {"overlap": -1}, {"text": "nope"}):
        with pytest.raises(ValueError):
            chunk_text(df, **kw)


QA = "Intro\nQ1: first?\n\nAns: one\n\nANALYSIS: because\nQ2: second?\n\nAns: two\n\nANALYSIS: so\n"


def test_pairs(spark):
    assert pairs(spark, QA) == [("first?", "one", "because"), ("second?", "two", "so")]
    assert pairs(spark, "no questions") == [] and pairs(spark, "") == [] and pairs(spark, None) == []


def test_missing_parts_are_borrowed_from_the_next_question(spark):
    text = "Q1: a?\n\nAns: one\nQ2: b?\n\nAns: two\n\nANALYSIS: late\nQ3: c?\n\nAns: three\n"
    assert pairs(spark, text) == [("a?", "one", "late"), ("b?", "two", "late"), ("c?", "three", "")]


def test_question_without_answer_swallows_up_to_the_next_answer(spark):
    assert pairs(spark, "Q1: a?\nQ2: b?\n\nAns: two") == [("a?\nQ2: b?", "two", "")]
    assert pairs(spark, "Q1: only a question") == [("only a question", "", "")]
    assert pairs(spark, "Q1: a?\n\nAns: one\nQ2: at the end\n") == [("a?", "one", ""), ("at the end", "", "")]


def test_question_mark_inside_an_answer_ends_it(spark):
    assert pairs(spark, "Q1: a?\n\nAns: see Q7: there\n\nANALYSIS: x") == [("a?", "see", "x"), ("there\n\nANALYSIS: x", "", "x")]


def test_answer_on_a_plain_line_belongs_to_the_question(spark):
    assert pairs(spark, "Q1: a?\nAns: one\n") == [("a?\nAns: one", "one", "")]


def test_empty_answer_takes_what_follows(spark):
    assert pairs(spark, "Q1: a?\n\nAns: \nQ2: b?\n\nAns: two") == [("a?", "Q2: b?\n\nAns: two", ""), ("b?", "two", "")]
    assert pairs(spark, "Q1: a?\n\nAns: ") == [("a?", "", "")]


def test_other_digits_and_spaces(spark):
    assert pairs(spark, "Q١٢:　a?\n\nAns: one　") == [("a?", "one", "")]


def test_many_pairs(spark):
    n = 700
    text = "\n".join(f"Q{i}: q{i}\n\nAns: a{i}" for i in range(n)) + "\n\nANALYSIS: end"
    assert pairs(spark, text) == [(f"q{i}", f"a{i}", "end") for i in range(n)]


def test_units_are_chunks_then_pairs(spark):
    df = spark.createDataFrame([("d", QA), ("e", "plain"), ("f", "")], SCHEMA)
    rows = document_units(df).orderBy("file_id", "chunk_idx").collect()
    assert [(r["file_id"], r["chunk_idx"], r["chunk_type"]) for r in rows] == [
        ("d", 0, "text"), ("d", 1, "qa_pair"), ("d", 2, "qa_pair"), ("e", 0, "text"),
    ]
    assert rows[1]["full_text"] == "Question: first?\nAnswer: one\nAnalysis: because"
    assert rows[0]["question_text"] is None and rows[1]["analysis_text"] == "because"
    no_analysis = spark.createDataFrame([("d", "Q1: a\n\nAns: b")], SCHEMA)
    pair = document_units(no_analysis).filter("chunk_type = 'qa_pair'").first()
    assert pair["full_text"] == "Question: a\nAnswer: b" and pair["analysis_text"] == ""


def test_stored_text_is_cut_and_full_text_is_not(spark):
    df = spark.createDataFrame([("d", "x" * 800)], SCHEMA)
    r = document_units(df).first()
    assert len(r["original_text"]) == 500 and len(r["full_text"]) == 800


def test_metadata(spark):
    df = spark.createDataFrame([("d", QA, "d.txt"), ("f", "", "f.txt")], SCHEMA + ", filename string")
    rows = {r["file_id"]: r for r in document_metadata(df).collect()}
    d, f = rows["d"], rows["f"]
    assert (d["num_characters"], d["num_chunks"], d["num_qa_pairs"], d["has_questions"]) == (len(QA), 1, 2, True)
    assert (f["num_characters"], f["num_chunks"], f["num_qa_pairs"], f["has_questions"]) == (0, 0, 0, False)
    assert d["filename"] == "d.txt"


def test_no_shuffle_between_document_and_units(spark, table):
    docs = table("documents").select(F.col("doc_id").alias("file_id"), "text")
    plan = document_units(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
