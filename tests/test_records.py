"""CSV records with line breaks inside quotes, cut in all splits of a file at once."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factsheet.sources.csv import read_csv
from factsheet.sources.records import AT, FILE, RECORD, SPLIT, ends_inside, records


@pytest.fixture
def small_splits(spark):
    """Splits of a few dozen bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
    return str(path)


def odd_rows(rng, n):
    pieces = ["a", "b,c", 'q"x', '""', "line\nbreak", "\n\n", ",\n", '"\n"', "", 'end"\n', "é", " lead"]
    return [["i", "s", "t"]] + [[str(i), "x" + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))), rng.choice(["", "z", "two\nlines"])] for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_records_of_many_splits_equal_the_csv_module(spark, small_splits, tmp_path, seed):
    rows = odd_rows(random.Random(seed), 40)
    path = write(tmp_path / "t.csv", rows)
    found = records(spark, [path], None).orderBy(SPLIT, AT).collect()
    assert [next(csv.reader(io.StringIO(r[RECORD], newline=""))) for r in found] == rows
    assert len({r[SPLIT] for r in found}) > 10
    # Numbers within a split have no gaps, so that positions can be counted up.
    for split in {r[SPLIT] for r in found}:
        assert [r[AT] for r in found if r[SPLIT] == split] == list(range(sum(r[SPLIT] == split for r in found)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", ",", '"', '""', "\n", "b"]), max_size=30).map("".join))
def test_line_states_follow_the_rules(text):
    """Against a walk over single characters."""
    inside, at, start = False, 0, True
    states = []
    while at <= len(text):
        c = text[at : at + 1]
        if c in ("\n", ""):
            states.append(inside)
            start = start if inside else True
        elif inside and c == '"':
            if text[at + 1 : at + 2] == '"':
                at += 1
            else:
                inside, start = False, False
        elif not inside:
            if c == '"' and start:
                inside = True
            start = c == ","
        at += 1
    got, now = [], False
    for line in text.split("\n"):
        now = ends_inside(line, now)
        got.append(now)
    assert got == states


def table_of(spark, paths, **kw):
    table = read_csv(spark, paths, "f", **kw)
    return table, [tuple(r) for r in table.rows.orderBy("_row_index").drop("file_id", "_row_index").collect()]


def test_one_file_with_breaks_is_read_by_many_tasks(spark, small_splits, tmp_path):
    rows = odd_rows(random.Random(9), 50)
    path = write(tmp_path / "t.csv", rows)
    table, got = table_of(spark, path)
    assert got == [(int(a), b, c or None) for a, b, c in rows[1:]]
    assert [r["i"] for r in table.rows.orderBy("_row_index").collect()] == list(range(50))
    assert table.rows.agg(F.max("_row_index"), F.count_distinct("_row_index")).first() == (49, 50)
    one = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert table_of(spark, path)[1] == got
    spark.conf.set("spark.sql.files.maxPartitionBytes", one)


def test_headers_over_any_number_of_lines(spark, tmp_path):
    header = "key" + "\nof" * 300
    paths = [write(tmp_path / "1.csv", [[header, "b"], ["1", "x\ny"]]), write(tmp_path / "2.csv", [["b", header], ["z", "2"]])]
    table, got = table_of(spark, paths)
    assert table.rows.columns[2:] == [header, "b"] and got == [(1, "x\ny"), (2, "z")]


def test_quotes_amid_a_field_and_an_open_end(spark, small_splits, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,5" pipe\n2,"tube, 7""\n wide"\n\n3,6" and 7" rods\n4,"never\nclosed\n')
    assert table_of(spark, str(path))[1] == [(1, '5" pipe'), (2, 'tube, 7"\n wide'), (3, '6" and 7" rods'), (4, "never\nclosed")]
    # The quotes of each line are even in number, and still one field goes over two lines.
    path.write_text('a,b,c\n5" pipe,"open\nrest",7" tube\n')
    assert table_of(spark, str(path))[1] == [('5" pipe', "open\nrest", '7" tube')]


def test_files_with_and_without_breaks_in_one_table(spark, small_splits, tmp_path):
    paths = [
        write(tmp_path / "1.csv", [["a", "b"], ["1", "x"], ["2", "y"]]),
        write(tmp_path / "2.csv", [["b", "a"], ["p\nq", "3"]]),
        write(tmp_path / "3.csv", [["b", "a"], ["r", "4"]]),
    ]
    table, got = table_of(spark, paths)
    assert got == [(1, "x"), (2, "y"), (3, "p\nq"), (4, "r")]
    own = read_csv(spark, paths)
    ids = {r["filename"]: r["file_id"] for r in own.files.collect()}
    assert len(set(ids.values())) == 3
    assert sorted((r["_row_index"], r["a"]) for r in own.rows.filter(F.col("file_id") == ids["1.csv"]).collect()) == [(0, 1), (1, 2)]


def test_files_of_one_name_and_content_get_two_ids(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s.csv").write_text("n\n1\n")
    ids = [r["file_id"] for r in read_csv(spark, [str(tmp_path / f / "s.csv") for f in ("x", "y")]).files.collect()]
    assert len(set(ids)) == 2 and all(i.startswith("s_") for i in ids)
    again = read_csv(spark, str(tmp_path / "x")).files.first()["file_id"]
    assert again in ids
    (tmp_path / "x" / "s.csv").write_text("n\n2\n")
    assert read_csv(spark, str(tmp_path / "x")).files.first()["file_id"] not in ids
