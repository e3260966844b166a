from pyspark.sql import types as T

from factsheet.sources.vectors import list_stores, read_vectors
from factsheet.streaming.watch import watch_documents, watch_rows


def test_documents_arrive_in_steps(spark, tmp_path):
    folder, store, state = tmp_path / "in", str(tmp_path / "v"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.txt").write_text("Q1: why?\n\nAns: so")
    watch_documents(spark, str(folder), store, state, dimension=8, buckets=2).awaitTermination(120)
    first = read_vectors(spark, store)
    assert first.count() == 2
    (folder / "b.txt").write_text("plain")
    watch_documents(spark, str(folder), store, state, dimension=8, buckets=2).awaitTermination(120)
    both = read_vectors(spark, store)
    assert [r["num_vectors"] for r in list_stores(both).collect()] == [2, 1]
    fid = both.filter("original_text = 'plain'").first()["file_id"]
    assert read_vectors(spark, store, fid).count() == 1


def test_rows_arrive(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.csv").write_text("item,price,n\npen,$ 1-,7\ncup,NA,x\n")
    schema = T.StructType().add("item", "string").add("price", "double").add("n", "long")
    watch_rows(spark, str(folder), schema, out, str(tmp_path / "state"), numbers=["price"]).awaitTermination(120)
    rows = sorted(tuple(r) for r in spark.read.parquet(out).select("item", "price", "n").collect())
    assert rows == [("cup", None, None), ("pen", -1.0, 7)]
