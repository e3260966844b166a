"""The vector table: loads that replace files, keys, streams, compaction."""

import pytest
from pyspark.sql import functions as F

from factsheet.sources import vectors as store
from factsheet.sources.vectors import add_vectors, clear_retired, commits, compact, list_stores, read_vectors
from factsheet.streaming.watch import watch_documents, watch_rows

SCHEMA = "file_id string, n int, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(f, n, [float(n), 1.0]) for f, n in rows], SCHEMA)


def held(spark, path, file_id=None):
    return sorted((r["file_id"], r["n"]) for r in read_vectors(spark, path, file_id).collect())


def test_the_load_committed_last_counts_for_each_file(spark, tmp_path):
    path = str(tmp_path / "v")
    add_vectors(frame(spark, [("a", 1), ("a", 2), ("b", 3)]), path, 2, buckets=4)
    add_vectors(frame(spark, [("c", 4)]), path, 2)
    add_vectors(frame(spark, [("a", 5), ("d", 6)]), path, 2, buckets=8)
    add_vectors(frame(spark, []), path, 2)
    assert held(spark, path) == [("a", 5), ("b", 3), ("c", 4), ("d", 6)]
    assert held(spark, path, "a") == [("a", 5)] and held(spark, path, "none") == []
    assert [c.rows for c in commits(spark, path)] == [3, 1, 2, 0]


def test_reading_moves_no_vectors(spark, tmp_path):
    path = str(tmp_path / "v")
    for n in range(3):
        add_vectors(frame(spark, [("a", n), (f"b{n}", n)]), path, 2, buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = read_vectors(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The vectors' side of the join is the scan itself; only the list of files is shuffled.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    scans = [line for line in plan.splitlines() if "embedding" in line and "Exchange" in line]
    assert not scans
    alone = str(tmp_path / "w")
    add_vectors(frame(spark, [("a", 1)]), alone, 2)
    plan = read_vectors(spark, alone)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_many_outdated_files_are_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    for n in range(2):
        add_vectors(frame(spark, [(f"f{i}", n) for i in range(20)]), path, 2, buckets=2)
    monkeypatch.setattr(store, "BROADCAST_ROWS", 3)
    assert held(spark, path) == sorted((f"f{i}", 1) for i in range(20))


def test_a_key_counts_once_and_a_failed_load_never(spark, tmp_path):
    path = str(tmp_path / "v")
    assert add_vectors(frame(spark, [("a", 1)]), path, 2, key="x/0")
    assert not add_vectors(frame(spark, [("a", 2)]), path, 2, key="x/0")
    assert add_vectors(frame(spark, [("b", 2)]), path, 2, key="y/0")
    with pytest.raises(Exception, match="dimension"):
        add_vectors(frame(spark, [("a", 7)]), path, 3, key="x/1")
    # Written, but ended before its commit.
    orphan = frame(spark, [("a", 9)]).withColumn("file_bucket", F.lit(0))
    orphan.write.partitionBy("file_bucket").parquet(f"{path}/data/_load=orphan/_buckets=4")
    assert held(spark, path) == [("a", 1), ("b", 2)]
    assert add_vectors(frame(spark, [("a", 3)]), path, 2, key="x/1")
    assert held(spark, path) == [("a", 3), ("b", 2)]
    assert clear_retired(spark, path) >= 1 and held(spark, path) == [("a", 3), ("b", 2)]


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "v")
    for n in range(4):
        add_vectors(frame(spark, [("a", n), (f"b{n}", n)]), path, 2, key=f"k/{n}")
    before = held(spark, path)
    assert compact(spark, path, buckets=2) == 4 and held(spark, path) == before
    assert held(spark, path, "b2") == [("b2", 2)]
    assert compact(spark, path) == 0 and clear_retired(spark, path) == 8 and held(spark, path) == before
    # Keys of retired loads stay known; later loads replace compacted files.
    assert not add_vectors(frame(spark, [("a", 50)]), path, 2, key="k/1")
    add_vectors(frame(spark, [("a", 60)]), path, 2)
    assert ("a", 60) in held(spark, path) and len(held(spark, path)) == 5


def test_a_load_committed_during_compaction_stays_later(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    for n in range(2):
        add_vectors(frame(spark, [("a", n), ("b", n)]), path, 2)
    write = store._write

    def slow(rows, *args):
        monkeypatch.setattr(store, "_write", write)
        add_vectors(frame(spark, [("a", 9)]), path, 2)
        write(rows, *args)

    monkeypatch.setattr(store, "_write", slow)
    compact(spark, path)
    assert held(spark, path) == [("a", 9), ("b", 1)]


def test_columns_of_several_loads(spark, tmp_path):
    path = str(tmp_path / "v")
    add_vectors(frame(spark, [("a", 1)]), path, 2)
    add_vectors(frame(spark, [("b", 2)]).withColumn("note", F.lit("x")), path, 2)
    rows = sorted(tuple(r) for r in read_vectors(spark, path).select("file_id", "n", "note").collect())
    assert rows == [("a", 1, None), ("b", 2, "x")]


def test_nothing_loaded(spark, tmp_path):
    with pytest.raises(ValueError, match="no vectors"):
        read_vectors(spark, str(tmp_path / "none"))
    add_vectors(frame(spark, []), str(tmp_path / "e"), 2)
    assert read_vectors(spark, str(tmp_path / "e")).columns == ["file_id", "n", "embedding"]
    assert read_vectors(spark, str(tmp_path / "e")).count() == 0


def test_two_streams_and_a_batch_in_one_table(spark, tmp_path):
    path = str(tmp_path / "v")

    def watch(name):
        watch_documents(spark, str(tmp_path / name), path, str(tmp_path / f"state-{name}"), dimension=8, buckets=2).awaitTermination(120)

    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.txt").write_text(f"text of {name}")
        watch(name)
    add_vectors(frame(spark, [("batch", 1)]), path, 2)
    (tmp_path / "x" / "later.txt").write_text("later")
    watch("x")
    texts = {r["original_text"] for r in read_vectors(spark, path).collect()}
    assert texts == {"text of x", "text of y", "later", None}
    assert len(list_stores(read_vectors(spark, path)).collect()) == 4


def test_two_streams_of_rows_in_one_folder(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType().add("item", "string")
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text(f"item\n{name}\n")
        watch_rows(spark, str(tmp_path / name), schema, str(tmp_path / "out"), str(tmp_path / f"state-{name}")).awaitTermination(120)
    assert sorted(r["item"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y"]
