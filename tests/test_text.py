import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsheet.functions.hashing import source_id
from factsheet.functions.text import SPACE, clean_number, double_text, printed, row_text, strip

CLEANED = {
    "1,234.5": 1234.5, "5-": -5.0, "$ 9": 9.0, "1995-03-15": 1995.0, "Brand#12": 12.0, "1.2.3": 1.2,
    "1e5": 100000.0, "12 kg": 12.0, "1.5-": -1.5, ".5": 0.5, "5.": 5.0, "+3": 3.0, " 7 ": 7.0, "-1.2.3": -1.2,
    "١٢": 12.0, "1E+2": 100.0, " 8 ": 8.0, "4-\n": -4.0, "1e999": math.inf,
    "": None, "abc": None, "--5": None, "-1-2": None, "-5-": None, "1e": None, "e": None, "..5": None,
    "1-URGENT": None, "3 pieces": None, "Customer#000000001": None, "5-LOW": None, None: None, "-": None,
}


def test_clean_number(spark):
    df = spark.createDataFrame([(k,) for k in CLEANED], "v string")
    got = {r["v"]: r["x"] for r in df.select("v", clean_number(F.col("v")).alias("x")).collect()}
    assert got == CLEANED


DOUBLES = [
    0.0, -0.0, 1.0, -1.5, 0.1, 1e-4, 1.5e-4, 9.9e-5, 1.5e-5, 1e-10, 2.5e-300, 1234567.0, 12345678.0, 1e7, 1.25e8,
    123456789.125, -98765432.1, 1e15, 9999999999999998.0, 1e16, 1.2e16, -3e20, 1e100, 1.7976931348623157e308,
    math.inf, -math.inf, math.nan,
]


def test_double_text_is_python_repr(spark):
    df = spark.createDataFrame([(x,) for x in DOUBLES], "x double")
    assert [r[0] for r in df.select(double_text(F.col("x"))).collect()] == [repr(x) for x in DOUBLES]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.decimals(min_value=-(10**12), max_value=10**12, places=3), min_size=50, max_size=200))
def test_double_text_of_decimals(spark, values):
    floats = [float(v) for v in values]
    df = spark.createDataFrame([(x,) for x in floats], "x double").coalesce(1)
    got = [r[0] for r in df.select(double_text(F.col("x"))).collect()]
    assert got == [repr(x) for x in floats]


def test_strip_takes_all_white_space(spark):
    df = spark.createDataFrame([(SPACE + "a b" + SPACE,)], "v string")
    assert df.select(strip(F.col("v"))).first()[0] == "a b"


def test_printed_booleans(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [r[0] for r in df.select(printed(F.col("b"), T.BooleanType())).collect()] == ["True", "False", None]


def test_row_text_skips_missing_cells(spark):
    df = spark.createDataFrame(
        [(1, "x", 1.5, True), (None, None, float("nan"), None)], "`SL.NO` int, name string, v double, ok boolean"
    )
    assert [r[0] for r in df.select(row_text(df)).collect()] == ["SL.NO: 1 | name: x | v: 1.5 | ok: True", ""]


def test_row_text_of_numbers_only_prints_floats(spark):
    df = spark.createDataFrame([(1, 2.5)], "a bigint, b double")
    assert df.select(row_text(df)).first()[0] == "a: 1.0 | b: 2.5"
    ints = df.select("a")
    assert ints.select(row_text(ints)).first()[0] == "a: 1"


def test_source_id_is_stable(spark):
    rows = [("file:/x/my file.v1.csv", "aa"), ("file:/x/my file.v1.csv", "ab"), ("file:/y/my file.v1.csv", "aa"), ("file:/x/.hidden", "a")]
    df = spark.createDataFrame(rows, "p string, t string")
    ids = [r[0] for r in df.select(source_id(F.col("p"), F.col("t"))).collect()]
    assert len(set(ids)) == 4 and all(i.startswith("my_file.v1_") and len(i) == len("my_file.v1_") + 16 for i in ids[:3])
    assert ids[3].startswith(".hidden_")
    assert ids == [r[0] for r in df.select(source_id(F.col("p"), F.col("t"))).collect()]
