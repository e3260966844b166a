"""Every registered query against its SQL, on whole tables; and the shape of the plans."""

import math

import duckdb
import pytest

from __spark_entry__ import entry
from factsheet.plans.oracle import ORACLE
from factsheet.plans.queries import QUERIES, TABLES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def ordered(rows, names):
    def cell(x):
        return None if isinstance(x, float) and math.isnan(x) else x

    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, SMALL)
    expected = sql.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert ordered(df.collect(), df.columns) == ordered(expected.fetchall(), expected.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


def plan(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["filter_gt", "sort_desc_limit", "top_n", "bottom_n", "top_n_lineitem", "sample_head"])
def test_limits_are_bounded_heaps(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "filter_rows")
    assert "GreaterThanOrEqual(l_quantity,45.0)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_quantity:double>" in p
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in plan(spark, "compare_averages_group")


def test_group_limit_runs_before_the_shuffle(spark):
    for name in ("profile_categorical", "knn"):
        assert "WindowGroupLimit" in plan(spark, name)


def test_grouped_numbers_share_one_aggregation(spark):
    df = QUERIES["compare_averages_group_numbers"](spark, SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1
