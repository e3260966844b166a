import numpy as np
import pytest
from pyspark.sql import functions as F

from factsheet import (
    categorical_summary,
    clean_table,
    column_summaries,
    numeric_summary,
    row_units,
    table_fingerprint,
    table_profile,
)
from factsheet.operators import quantile
from factsheet.operators.quantile import medians


@pytest.mark.parametrize(
    "values",
    [
        [1.0, 2.0, 3.0, 4.0],
        [5.0],
        list(range(1000)),
        [7.0] * 500 + list(range(700)),
        [0.0] * 400 + [1e300, -1e300, 1e-300] * 50,
        [float("inf"), float("-inf"), 1.0, 2.0, 3.0] * 20,
        [1.7e308, -1.7e308] * 20 + [3.0],
        list(np.random.default_rng(0).lognormal(0, 9, 1001)),
        [float("inf")] * 7,
    ],
)
def test_interval_search_finds_exact_medians(spark, values):
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "x double, i int")
    for small in (0, 1 << 16):
        got = medians(df, ["x", "i"], small=small)
        assert got["x"] == np.median(np.array(values, float)) and got["i"] == np.median(np.arange(len(values)))


def test_brackets_that_miss_are_widened(spark, monkeypatch):
    # A sketch so small that its brackets are wrong; counting finds out.
    monkeypatch.setattr(quantile, "SKETCH", 8)
    values = np.random.default_rng(4).lognormal(0, 3, 20_001)
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(8)
    for small in (0, 1 << 16):
        monkeypatch.setattr(quantile, "MARGINS", (0.0001, 0.001, 0.5))
        assert medians(df, ["x"], small=small) == {"x": np.median(values)}


def test_two_scans_whatever_the_number_of_columns(spark, table, monkeypatch):
    lineitem = table("lineitem")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_orderkey", "l_suppkey", "l_linenumber"]
    plans = []
    count = quantile._counted
    monkeypatch.setattr(quantile, "_counted", lambda *a: plans.append(a) or count(*a))
    found = medians(lineitem, names)
    assert len(plans) == 1
    pdf = lineitem.select(*names).toPandas()
    assert found == {c: pytest.approx(float(pdf[c].median())) for c in names}


def test_long_texts_are_counted_by_digest(spark):
    start = "x" * 100
    values = [start + s for s in "bbbaaac"] + ["short", "short", start, None, "y" * 64, "y" * 65, "y" * 65]
    df = spark.createDataFrame([(i, v, "k") for i, v in enumerate(values)], "_row_index bigint, s string, t string")
    by_key = {r["column"]: r for r in categorical_summary(df, ["s", "t"], "_row_index").collect()}
    assert by_key["s"]["unique_values"] == 7 and by_key["s"]["top_values"] == [start + "b", start + "a", "short"]
    assert by_key["t"]["unique_values"] == 1 and by_key["t"]["top_values"] == ["k"]
    # Equal counts and equal starts: the whole texts decide.
    assert categorical_summary(df, ["s"]).first()["top_values"] == [start + "a", start + "b", "short"]
    many = spark.createDataFrame([(start + str(i),) for i in range(50)], "s string")
    assert categorical_summary(many, ["s"]).first()["top_values"] == [start + "0", start + "1", start + "10"]
    plan = categorical_summary(df, ["s"], "_row_index")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_median_ignores_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert medians(df, ["x"]) == {"x": 2.0}
    assert medians(df.filter("x is null"), ["x"]) == {"x": None}


def test_column_summaries(spark):
    df = spark.createDataFrame(
        [(0, 1.5, "b", True, None), (1, 2.5, "a", False, None), (2, None, "a", True, None), (3, 4.0, None, True, None)],
        "_row_index bigint, x double, s string, ok boolean, e double",
    )
    got = {r[0]: r[1] for r in column_summaries(df, ["x", "s", "ok", "e"], "_row_index").collect()}
    assert got == {
        "x": "Column x: numeric. Min: 1.5, Max: 4.0, Mean: 2.67, Median: 2.5",
        "s": "Column s: text/categorical. Unique values: 2. Top values: a, b",
        "ok": "Column ok: numeric. Min: False, Max: True, Mean: 0.75, Median: 1.0",
        "e": "Column e: numeric. Min: nan, Max: nan, Mean: nan, Median: nan",
    }


def test_equal_counts_come_in_order_of_appearance(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate("dcbaab")], "_row_index bigint, s string")
    assert categorical_summary(df, ["s"], "_row_index").first()["top_values"] == ["b", "a", "d"]
    assert categorical_summary(df, ["s"]).first()["top_values"] == ["a", "b", "c"]
    empty = categorical_summary(df.withColumn("s", F.lit(None).cast("string")), ["s"]).first()
    assert empty["unique_values"] == 0 and empty["top_values"] == []


def test_numeric_summary_of_dotted_names(spark):
    df = spark.createDataFrame([(1, 2.0), (3, None)], "`SL.NO` bigint, x double")
    rows = {r["column"]: tuple(r)[1:] for r in numeric_summary(df).collect()}
    assert rows == {"SL.NO": (1.0, 3.0, 2.0, 2.0), "x": (2.0, 2.0, 2.0, 2.0)}


def test_table_profile(spark):
    df = spark.createDataFrame([(0, 1, "a", True)], "_row_index bigint, n bigint, s string, b boolean")
    p = table_profile(df, "f", "f.csv", skip=["_row_index"]).first()
    assert (p["num_rows"], p["num_columns"], p["columns"]) == (1, 3, ["n", "s", "b"])
    assert p["column_types"] == {"n": "int64", "s": "object", "b": "bool"}
    assert p["numeric_columns"] == ["n", "b"] and p["text_columns"] == ["s"]


def test_fingerprint_depends_on_content_only(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "n int, s string")
    base = table_fingerprint(df).first()["fingerprint"]
    assert table_fingerprint(df.orderBy(F.desc("n")).repartition(3)).first()["fingerprint"] == base
    assert table_fingerprint(df.fillna("")).first()["fingerprint"] != base
    assert table_fingerprint(df.withColumnRenamed("s", "t")).first()["fingerprint"] != base
    assert table_fingerprint(df.limit(0)).first()["fingerprint"] != base


def test_clean_table(spark):
    rows = [(i, f"{i}-", "Brand#12" if i % 2 else "none", "abc", f"20{i:02d}-01-01") for i in range(40)]
    rows.append((40, None, "Brand#3", "7", "2041-01-01"))
    df = spark.createDataFrame(rows, "_row_index bigint, price string, brand string, word string, day string")
    got = clean_table(df, exclude=["day"])
    # word has no digit among its first ten values; brand is a number in just over half of all rows.
    assert dict(got.dtypes) == {"_row_index": "bigint", "price": "double", "brand": "double", "word": "string", "day": "string"}
    r = {x["_row_index"]: x for x in got.collect()}
    assert r[5]["price"] == -5.0 and r[40]["price"] is None and r[1]["brand"] == 12.0 and r[0]["brand"] is None
    assert dict(clean_table(df).dtypes)["day"] == "double"


def test_clean_table_needs_more_than_half_of_all_rows(spark):
    df = spark.createDataFrame([(0, "1"), (1, "2"), (2, None), (3, None)], "_row_index bigint, v string")
    assert dict(clean_table(df).dtypes)["v"] == "string"
    assert dict(clean_table(df.limit(0)).dtypes)["v"] == "string"


def test_row_units(spark):
    df = spark.createDataFrame([(0, "x" * 600), (1, "y")], "_row_index bigint, s string")
    rows = {r["row_idx"]: r for r in row_units(df, "f").collect()}
    assert len(rows[0]["original_text"]) == 500 and len(rows[0]["full_text"]) == 603
    assert rows[-1]["column_name"] == "s" and not rows[-1]["is_row_vector"] and len(rows[-1]["original_text"]) > 500
    assert rows[1]["full_text"] == "s: y" and rows[1]["is_row_vector"]


def test_means_in_sentences_round_like_python(spark):
    df = spark.createDataFrame([(0, 0.125, 1.005, 2.675)], "k int, a double, b double, c double")
    text = " ".join(r["summary"] for r in column_summaries(df, ["a", "b", "c"], "k").collect())
    assert "Mean: 0.12," in text and "Mean: 1.00," in text and "Mean: 2.67," in text


def test_cleaning_that_looks_at_all_rows(spark):
    df = spark.createDataFrame([(i, "x" if i < 10 else f"{i}-") for i in range(40)], "_row_index bigint, s string")
    assert dict(clean_table(df).dtypes)["s"] == "string" and dict(clean_table(df, sample=None).dtypes)["s"] == "double"
