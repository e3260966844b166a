import operator

import pytest
from pyspark.sql import functions as F

from factsheet import compare_averages, compare_top, filter_rows, filter_threshold, sample_head, sort_data, top_n
from factsheet.functions.positions import positions

NAN = float("nan")


@pytest.fixture
def gaps(spark):
    return spark.createDataFrame(
        [(0, 1.0, "a"), (1, NAN, "b"), (2, None, "c"), (3, 2.0, "d"), (4, 2.0, "e")], "_row_index bigint, x double, s string"
    )


@pytest.mark.parametrize(
    "op, indices",
    [(">", [3, 4]), ("<", []), (">=", [0, 3, 4]), ("<=", [0]), ("==", [0]), ("!=", [1, 2, 3, 4])],
)
def test_filter_reads_nan_as_missing(gaps, op, indices):
    answer = filter_threshold(gaps, "x", op, 1.0)
    assert [r["_row_index"] for r in answer.result.collect()] == indices
    n = answer.numbers.first()
    assert n["total_rows"] == 5 and n["filtered_rows"] == len(indices) and n["row_indices"] == indices
    assert n["percentage_matched"] == 100 * len(indices) / 5


def test_filter_of_empty_table(gaps):
    n = filter_threshold(gaps.limit(0), "x", ">", 1.0).numbers.first()
    assert (n["total_rows"], n["filtered_rows"], n["percentage_matched"], n["row_indices"]) == (0, 0, 0.0, [])


def test_filter_shows_first_hundred_and_counts_all(spark):
    df = spark.range(1000).selectExpr("id as _row_index", "id as x").repartition(7)
    answer = filter_threshold(df, "x", ">=", 10)
    assert [r["x"] for r in answer.result.collect()] == list(range(10, 110))
    n = answer.numbers.first()
    assert n["filtered_rows"] == 990 and n["row_indices"] == list(range(10, 110))


def test_filter_errors(gaps):
    for args in (("s", ">", 1.0), ("nope", ">", 1.0), ("x", "~", 1.0)):
        with pytest.raises(ValueError):
            filter_threshold(gaps, *args)


def test_dotted_column_and_boolean(spark):
    df = spark.createDataFrame([(0, 5, True), (1, 7, False)], "_row_index bigint, `SL.NO` bigint, ok boolean")
    assert top_n(df, "SL.NO", 1).result.first()["SL.NO"] == 7
    assert filter_threshold(df, "ok", "==", 1).numbers.first()["row_indices"] == [0]
    assert filter_threshold(df, "SL.NO", "<", 7).numbers.first()["row_indices"] == [0]


@pytest.mark.parametrize("ascending, order", [(True, [0, 3, 4, 1, 2]), (False, [3, 4, 0, 1, 2])])
def test_sort_puts_missing_last_both_ways(gaps, ascending, order):
    answer = sort_data(gaps, "x", ascending)
    assert [r["_row_index"] for r in answer.result.collect()] == order
    n = answer.numbers.first()
    assert n["last_value"] is None and n["first_value"] == (1.0 if ascending else 2.0)
    limited = sort_data(gaps, "x", ascending, 2)
    assert [r["_row_index"] for r in limited.result.collect()] == order[:2]
    m = limited.numbers.first()
    assert m["row_indices"] == order[:2] and m["returned_rows"] == 2 and m["total_rows"] == 5


def test_sort_limit_zero_is_no_limit(gaps):
    assert sort_data(gaps, "x", limit=0).result.count() == 5
    with pytest.raises(ValueError):
        sort_data(gaps, "x", limit=-1)


def test_top_n_with_more_than_there_are(gaps):
    n = top_n(gaps, "x", 10).numbers.first()
    assert n["top_values"] == [2.0, 2.0, 1.0, None, None] and n["top_indices"] == [3, 4, 0, 1, 2]
    assert n["highest_value"] == 2.0 and n["lowest_in_top"] is None and n["average_of_top"] is None
    assert top_n(gaps, "x", 3).numbers.first()["average_of_top"] == pytest.approx(5 / 3)


def test_bottom_n_highest_is_the_first(gaps):
    n = top_n(gaps, "x", 2, ascending=True).numbers.first()
    assert n["top_values"] == [1.0, 2.0] and n["highest_value"] == 1.0 and n["lowest_in_top"] == 2.0


def test_top_n_errors_and_empty(gaps):
    with pytest.raises(ValueError):
        top_n(gaps, "x", 0)
    with pytest.raises(ValueError):
        top_n(gaps, "s", 1)
    n = top_n(gaps.limit(0), "x", 3).numbers.first()
    assert n["top_values"] == [] and n["highest_value"] is None


def test_compare_top_sides_of_different_length(spark, gaps):
    other = spark.createDataFrame([(7, 9.0)], "_row_index bigint, x double")
    answer = compare_top(gaps, other, "x", 4, ("a", "b"))
    rows = [tuple(r) for r in answer.result.collect()]
    assert answer.result.columns == ["rank", "a_x", "a_index", "b_x", "b_index"]
    assert rows == [(1, 2.0, 3, 9.0, 7), (2, 2.0, 4, None, None), (3, 1.0, 0, None, None), (4, None, 1, None, None)]
    n = answer.numbers.first()
    assert n["a_top_values"] == [2.0, 2.0, 1.0, None] and n["b_top_values"] == [9.0]
    assert n["a_average"] == pytest.approx(5 / 3) and n["a_max"] == 2.0 and n["b_average"] == 9.0


def test_compare_averages_of_two_tables(spark, gaps):
    zero = spark.createDataFrame([(0.0,), (None,)], "x double")
    n = compare_averages(gaps, "x", zero, names=("a", "b")).numbers.first()
    assert n["a_average"] == pytest.approx(5 / 3) and n["b_average"] == 0.0
    assert n["difference"] == pytest.approx(5 / 3) and n["percent_difference"] == 0.0
    empty = compare_averages(gaps, "x", zero.limit(0), names=("a", "b")).numbers.first()
    assert empty["b_average"] is None and empty["percent_difference"] is None


def test_compare_averages_of_groups(spark):
    df = spark.createDataFrame([("b", 1.0), ("b", 3.0), ("a", NAN), (None, 11.0)], "k string, x double")
    answer = compare_averages(df, "x", group_by="k")
    assert [tuple(r) for r in answer.result.collect()] == [("a", None), ("b", 2.0)]
    n = answer.numbers.first()
    assert (n["overall_average"], n["max_average"], n["min_average"]) == (5.0, 2.0, 2.0)
    with pytest.raises(ValueError, match="different names"):
        compare_averages(df, "x", df, names=("a", "a"))


@pytest.mark.parametrize("op", [">", ">=", "<", "<=", "==", "!="])
@pytest.mark.parametrize("threshold", [3.0, 3.5, -3.5, 2.0**53, 2.0**63, -(2.0**70), NAN, float("inf")])
def test_integers_are_compared_exactly(spark, op, threshold):
    values = [None, -4, -3, 3, 4, 2**53, 2**53 + 1, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    compare = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}[op]
    expected = [v for v in values if (op == "!=" if v is None else compare(v, threshold))]
    assert [r["x"] for r in filter_rows(df, "x", op, threshold).collect()] == expected


def test_integer_filters_are_pushed(spark, table):
    plan = filter_rows(table("lineitem"), "l_partkey", ">", 3.5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_partkey,3)" in plan


def test_group_keys_become_text(spark):
    df = spark.createDataFrame([(10.0, True, 1), (9.0, False, 2), (NAN, None, 3)], "k double, b boolean, x int")
    assert [r[0] for r in compare_averages(df, "x", group_by="k").result.collect()] == ["9.0", "10.0"]
    assert [r[0] for r in compare_averages(df, "x", group_by="b").result.collect()] == ["False", "True"]


def test_single_table_figures(spark):
    one = spark.createDataFrame([(4.0,)], "x double")
    n = compare_averages(one, "x").numbers.first()
    assert n["std_dev"] is None and n["count"] == 1
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    answer = compare_averages(df, "x")
    assert {r["metric"]: r["value"] for r in answer.result.collect()} == {
        "average": 2.0, "std_dev": pytest.approx(2**0.5), "min": 1.0, "max": 3.0, "count": 3.0,
    }


@pytest.fixture
def long_lists(monkeypatch):
    """Every list is taken for a long one."""
    for module in ("factsheet.operators.select", "factsheet.functions.positions"):
        monkeypatch.setattr(f"{module}.HEAP_ROWS", 0)


def test_long_lists_equal_short_ones(spark, gaps, long_lists):
    top = top_n(gaps, "x", 10)
    assert [r["_row_index"] for r in top.result.collect()] == [3, 4, 0, 1, 2]
    assert [tuple(r) for r in top.ranked.orderBy("rank").collect()] == [(1, 2.0, 3), (2, 2.0, 4), (3, 1.0, 0), (4, None, 1), (5, None, 2)]
    n = top.numbers.first()
    assert n["top_indices"] == [3, 4, 0, 1, 2] and n["highest_value"] == 2.0 and n["average_of_top"] is None
    assert top_n(gaps, "x", 3).numbers.first()["average_of_top"] == pytest.approx(5 / 3)
    both = compare_top(gaps, gaps, "x", 2, ("a", "b"))
    assert [tuple(r) for r in both.result.collect()] == [(1, 2.0, 3, 2.0, 3), (2, 2.0, 4, 2.0, 4)]
    limited = sort_data(gaps, "x", True, 2)
    assert [r["_row_index"] for r in limited.result.collect()] == [0, 3] and limited.numbers.first()["row_indices"] == [0, 3]
    assert top_n(gaps.limit(0), "x", 3).ranked.count() == 0


def test_lists_among_the_numbers_are_bounded(gaps):
    n = top_n(gaps, "x", 3, listed=2)
    assert "top_values" not in n.numbers.columns and n.numbers.first()["highest_value"] == 2.0 and n.ranked.count() == 3
    assert "row_indices" not in sort_data(gaps, "x", limit=3, listed=2).numbers.columns
    assert "file1_top_values" not in compare_top(gaps, gaps, "x", 3, listed=2).numbers.columns


def test_positions_of_many_equal_rows_lie_in_many_tasks(spark, long_lists):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 5, id) as x", "1 as k").repartition(9)
    found = positions(df, [F.col("x").desc(), F.col("k")], "pos")
    assert found.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first() == (1, 20_000, 20_000)
    pairs = sorted((r["pos"], -r["x"]) for r in found.collect())
    assert [x for _, x in pairs] == sorted(x for _, x in pairs)
    plan = top_n(df, "x", 15_000, key="k").ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_sample_head(gaps):
    assert [r["_row_index"] for r in sample_head(gaps.repartition(3)).collect()] == [0, 1, 2]
