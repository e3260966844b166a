import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factsheet import document_context, document_query, embed_text, explain_row, nearest, row_units
from factsheet.functions.vectors import l2_normalize
from factsheet.operators import cells


def frame(spark, vectors, name="vec_id"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>").repartition(5)


def brute_force(corpus, queries, k):
    def unit(m):
        m = np.asarray(m, np.float32).astype(float)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    c, q = unit(corpus), unit(queries)
    d = np.round(((q[:, None, :] - c[None, :, :]) ** 2).sum(axis=2), 9)
    return {i: [(int(j), d[i, j]) for j in np.lexsort((np.arange(len(c)), d[i]))[:k]] for i in range(len(q))}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["distance"]))
    return out


def same(got, expected):
    assert got.keys() == expected.keys()
    for q in expected:
        assert [i for i, _ in got[q]] == [i for i, _ in expected[q]]
        assert [d for _, d in got[q]] == pytest.approx([d for _, d in expected[q]], abs=1e-8)


@pytest.mark.parametrize("k", [1, 5, 400])
def test_nearest_equals_brute_force(spark, k):
    rng = np.random.default_rng(k)
    corpus, queries = rng.normal(size=(300, 8)), rng.normal(size=(20, 8))
    got = nearest(frame(spark, corpus), frame(spark, queries, "query_id"), k)
    same(found(got), brute_force(corpus, queries, k))


def test_copies_tie_and_the_smallest_ids_win(spark, monkeypatch):
    rng = np.random.default_rng(0)
    corpus = np.concatenate([np.ones((200, 4)), rng.normal(size=(50, 4)), np.ones((100, 4)) * 3])
    queries = np.array([[1, 1, 1, 1], [0, 0, 0, 0], [1, 2, 3, 4]])
    expected = brute_force(corpus, queries, 7)
    same(found(nearest(frame(spark, corpus), frame(spark, queries, "query_id"), 7)), expected)


def test_small_slices_and_many_cuts(spark):
    rng = np.random.default_rng(3)
    corpus = np.round(rng.normal(size=(500, 3)), 1)
    queries = np.round(rng.normal(size=(40, 3)), 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = found(nearest(frame(spark, corpus).coalesce(2), frame(spark, queries, "query_id"), 4))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    same(got, brute_force(corpus, queries, 4))


def test_query_blocks_give_the_same_rows(spark):
    rng = np.random.default_rng(5)
    corpus, queries = rng.normal(size=(100, 4)), rng.normal(size=(60, 4))
    got = nearest(frame(spark, corpus), frame(spark, queries, "query_id"), 3, block_bytes=16 * 10)
    same(found(got), brute_force(corpus, queries, 3))


def test_file_filter_comes_before_the_search(spark):
    corpus = frame(spark, np.eye(4)).withColumn("file_id", F.when(F.col("vec_id") == 3, "b").otherwise("a"))
    got = nearest(corpus, frame(spark, [[1, 0, 0, 0]], "query_id"), 2, file_id="b").collect()
    assert [r["vec_id"] for r in got] == [3]


def test_nearest_of_nothing_and_errors(spark):
    corpus = frame(spark, np.eye(2))
    assert nearest(corpus, frame(spark, np.eye(2), "query_id").limit(0), 2).count() == 0
    assert nearest(corpus.limit(0), frame(spark, np.eye(2), "query_id"), 2).count() == 0
    with pytest.raises(ValueError):
        nearest(corpus, frame(spark, np.eye(2), "query_id"), 0)
    with pytest.raises(Exception, match="dimension"):
        nearest(corpus, frame(spark, np.eye(3), "query_id"), 1).collect()


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    got = [r[0] for r in df.select(l2_normalize(F.col("v"))).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0] and got[2] is None


def test_embed_text(spark):
    df = spark.createDataFrame([("Été été 12",), ("",), (None,), ("!?",)], "t string")
    got = [r["embedding"] for r in embed_text(df, "t", 64).collect()]
    assert sorted(x for x in got[0] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert all(g == [0.0] * 64 for g in got[1:])
    own = embed_text(df, "t", encoder=lambda c: F.array(F.length(c).cast("float")))
    assert own.first()["embedding"] == [10.0]


@pytest.fixture
def laptops(spark):
    rows = [(0, "red pen", 1.0), (1, "gaming laptop", 900.0), (2, "laptop bag", 30.0)]
    return spark.createDataFrame(rows, "_row_index bigint, name string, price double")


def test_explain_row(spark, laptops):
    units = embed_text(row_units(laptops, "shop"), "full_text", 512)
    queries = embed_text(
        spark.createDataFrame([(1, "name laptop bag price"), (2, "red pen"), (3, "column name text categorical unique values top")], "query_id int, q string"),
        "q", 512,
    )
    answer = explain_row(laptops, units, queries, 1)
    rows = {r["query_id"]: r for r in answer.result.collect()}
    assert rows[1]["name"] == "laptop bag" and rows[1]["_row_index"] == 2 and rows[2]["price"] == 1.0
    # The closest unit of the third query is a column summary, which takes the place and is dropped.
    assert 3 not in rows
    numbers = {r["query_id"]: r for r in answer.numbers.collect()}
    assert numbers[3]["row_indices"] == [] and numbers[2]["row_indices"] == [0] and numbers[2]["file_id"] == "shop"
    assert numbers[2]["similarity_scores"] == [rows[2]["_similarity_score"]]
    only = explain_row(laptops, units, queries, 2, rows_only=True).result
    assert only.groupBy("query_id").count().filter("count = 2").count() == 3


def test_search_arguments(spark, laptops):
    units = embed_text(row_units(laptops, "shop", with_summaries=False), "full_text", 16)
    queries = units.select(F.col("row_idx").alias("query_id"), "embedding")
    for k in (0, 11):
        with pytest.raises(ValueError):
            explain_row(laptops, units, queries, k)
    with pytest.raises(ValueError):
        document_query(units, queries)
    with pytest.raises(ValueError):
        explain_row(laptops, units.drop("is_row_vector"), queries)


def test_document_context(spark):
    rows = [
        (1, 1, 0.5, "text one", None, None, None),
        (1, 2, 0.25, "text two", "q2", "a2", ""),
        (1, 3, 0.0, "text three", "q3", "", "x"),
        (1, 4, -1.0, "text four", "q4", "a4", "n4"),
        (2, 1, 0.5, "alone", None, None, None),
    ]
    df = spark.createDataFrame(
        rows, "query_id int, rank int, similarity double, content string, question string, answer string, analysis string"
    )
    got = {r["query_id"]: r for r in document_context(df).collect()}
    assert got[1]["context_text"] == (
        "[Relevance: 0.50] text one\n\n[Relevance: 0.25] text two\n\n[Relevance: 0.00] text three\n\n[Relevance: -1.00] text four"
    )
    assert got[1]["qa_context"] == "\n\nRelevant Q&A pairs from analysis:\nQ: q2\nA: a2\n\nQ: q4\nA: a4\nAnalysis: n4"
    assert got[2]["qa_context"] == ""


def test_document_numbers_without_hits(spark):
    units = spark.createDataFrame(
        [], "file_id string, chunk_idx int, chunk_type string, original_text string, question_text string, "
        "answer_text string, analysis_text string, embedding array<float>",
    )
    queries = spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<float>")
    n = document_query(units, queries).numbers.first()
    assert (n["num_results"], n["avg_similarity"], n["file_ids"]) == (0, 0.0, [])


def test_explain_row_joins_within_a_file(spark):
    rows = [("a", 0, "red pen"), ("b", 0, "blue ink"), ("b", 1, "red pencil")]
    table = spark.createDataFrame(rows, "file_id string, _row_index bigint, name string")
    units = embed_text(row_units(table, "none", with_summaries=False), "full_text", 512)
    queries = embed_text(spark.createDataFrame([(1, "name blue ink")], "query_id int, q string"), "q", 512)
    result = explain_row(table, units, queries, 1).result.collect()
    assert [(r["file_id"], r["_row_index"], r["name"]) for r in result] == [("b", 0, "blue ink")]
    twice = queries.unionAll(queries)
    with pytest.raises(ValueError, match="unique"):
        nearest(units, twice, 1, ["file_id", "row_idx"])


# Query tables of any size: the join by cells


@pytest.fixture
def small_cells(monkeypatch):
    """Cells, blocks and turns of a few rows, so that small tables make many of each."""
    for name, n in (("RING_ROWS", 10), ("BLOCK_BYTES", 4 * 8 * 7), ("TURN_ROWS", 5), ("SAMPLE", 60)):
        monkeypatch.setattr(cells, name, n)


def clusters(rng, n, dimension=8, centers=12):
    middle = rng.normal(size=(centers, dimension)) * 10
    return middle[rng.integers(0, centers, n)] + rng.normal(size=(n, dimension))


def join(spark, corpus, queries, k):
    c = frame(spark, corpus).withColumnRenamed("embedding", "_vector")
    q = frame(spark, queries, "query_id").withColumnRenamed("embedding", "_vector")
    return cells.cell_join(c, q, k, ["vec_id"])


@pytest.mark.parametrize("shape, k", [("random", 5), ("clusters", 1), ("copies", 5), ("copies", 400), ("few", 5)])
def test_cells_equal_brute_force(spark, small_cells, shape, k):
    rng = np.random.default_rng(k)
    if shape == "random":
        corpus, queries = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    elif shape == "clusters":
        both = clusters(rng, 340)
        corpus, queries = both[:300], both[300:]
    elif shape == "copies":
        # Half of all rows and of all queries are one vector, some have length zero.
        corpus = np.concatenate([np.ones((150, 8)), rng.normal(size=(140, 8)), np.zeros((10, 8))])
        queries = np.concatenate([np.ones((20, 8)) * 2, rng.normal(size=(19, 8)), np.zeros((1, 8))])
    else:
        corpus, queries = rng.normal(size=(3, 8)), rng.normal(size=(4, 8))
    got = nearest(frame(spark, corpus), frame(spark, queries, "query_id"), k, block_bytes=0)
    same(found(got), brute_force(corpus, queries, k))


def test_cells_that_no_query_reaches_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(cells, "RING_ROWS", 40)
    both = clusters(np.random.default_rng(2), 2200, centers=30)
    corpus, queries = both[:2000], both[2000:][:20]
    best, _, figures = join(spark, corpus, queries, 3)
    assert figures["rings"] > 40 and figures["pairs"] < 0.2 * figures["rings"] * 20
    assert figures["reached"] < figures["rings"]
    same(found(nearest(frame(spark, corpus), frame(spark, queries, "query_id"), 3, block_bytes=0)), brute_force(corpus, queries, 3))


def test_cells_read_the_corpus_once_however_many_queries(spark, small_cells):
    rng = np.random.default_rng(7)
    for n in (10, 200):
        best, stored, figures = join(spark, rng.normal(size=(200, 8)), rng.normal(size=(n, 8)), 2)
        plan = best._jdf.queryExecution().executedPlan().toString()
        # One scan of the stored corpus and one of the stored queries.
        assert plan.count("FileScan parquet") == 2
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert figures["pairs"] > 200


def test_cells_keep_other_columns_of_hits_only(spark, small_cells):
    rng = np.random.default_rng(3)
    corpus, queries = rng.normal(size=(90, 4)), rng.normal(size=(30, 4))
    table = frame(spark, corpus).withColumns({"text": F.concat(F.lit("t"), "vec_id"), "distance_": F.lit(1)})
    got = nearest(table, frame(spark, queries, "query_id"), 2, keep=["text", "distance_"], block_bytes=0)
    assert got.columns == ["query_id", "rank", "distance", "vec_id", "text", "distance_"]
    rows = got.collect()
    assert len(rows) == 60 and all(r["text"] == f"t{r['vec_id']}" for r in rows)
    same(found(got), brute_force(corpus, queries, 2))


def test_cells_of_nothing_and_errors(spark):
    corpus, queries = frame(spark, np.eye(2)), frame(spark, np.eye(2), "query_id")
    assert nearest(corpus.limit(0), queries, 2, block_bytes=0).count() == 0
    assert nearest(corpus.limit(0).withColumn("t", F.lit("x")), queries, 2, keep=["t"], block_bytes=0).count() == 0
    with pytest.raises(Exception, match="dimension"):
        nearest(corpus, frame(spark, np.eye(3), "query_id"), 1, block_bytes=0).collect()
    missing = corpus.unionByName(spark.createDataFrame([(9, None)], corpus.schema))
    with pytest.raises(Exception, match="dimension"):
        nearest(missing, queries, 1, block_bytes=0).collect()
    with pytest.raises(Exception, match="dimension"):
        nearest(corpus, missing.withColumnRenamed("vec_id", "query_id"), 1, block_bytes=0).collect()


def test_searches_by_cells(spark, laptops, small_cells):
    units = embed_text(row_units(laptops, "shop"), "full_text", 512)
    queries = embed_text(spark.createDataFrame([(1, "name laptop bag price"), (2, "red pen")], "query_id int, q string"), "q", 512)
    one = explain_row(laptops, units, queries, 1)
    two = explain_row(laptops, units, queries, 1, block_bytes=0)
    assert sorted(map(str, one.result.collect())) == sorted(map(str, two.result.collect()))
    assert sorted(map(str, one.numbers.collect())) == sorted(map(str, two.numbers.collect()))


def test_a_query_leaves_a_block_of_many_rings_with_k_rows(spark, monkeypatch):
    monkeypatch.setattr(cells, "RING_ROWS", 16)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, _vector array<float>")
    best, _, figures = cells.cell_join(rows, rows.withColumnRenamed("vec_id", "query_id"), 5, ["vec_id"])
    found = best.collect()
    assert figures["rings"] > 20 and len(found) == 400 * 5
    unit = cells.unit_rows(vectors)
    exact = np.round(cells.squared_distances(unit, unit), cells.DIGITS)
    for q in range(0, 400, 37):
        nearest = sorted((d, i) for i, d in enumerate(exact[q]))[:5]
        assert [i for _, i in nearest] == [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: (r.distance, r.vec_id))]


def test_blocks_hold_rings_up_to_their_size():
    assert cells._blocks([(1, 10), (2, 20), (5, 3), (6, 70), (8, 5)], 32) == [(1, 0, 1), (2, 0, 1), (5, 1, 1), (6, 2, 3), (8, 5, 1)]


def test_block_is_laid_out_without_a_second_copy():
    rng, n, dimension = np.random.default_rng(5), 4096, 128
    vectors = rng.normal(size=(n, dimension)).astype(np.float32)

    def batch(rows, query):
        m, none = len(rows), pa.nulls(len(rows), pa.int64())
        offsets = pa.array(np.arange(m + 1, dtype=np.int32) * dimension)
        columns = {"_block": np.zeros(m, np.int32), "_turn": np.zeros(m, np.int32), "_query": pa.array([query] * m), "id": none if query else pa.array(rows), "_at": none if query else pa.array(rows)}
        columns |= {"_ring": pa.array(rows % 3, pa.int32()), "_vector": pa.ListArray.from_arrays(offsets, pa.array(vectors[rows].reshape(-1)))}
        columns |= {"query_id": pa.array(rows), "_bound": pa.array(np.full(m, 9.0)), "_rings": pa.array([[0, 1, 2]] * m, pa.list_(pa.int32()))}
        return pa.RecordBatch.from_pydict(columns)

    batches = [batch(np.arange(i, i + 256), False) for i in range(0, n, 256)] + [batch(np.arange(0, 40), True)]
    old, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        found = pa.Table.from_batches(list(cells._join(dimension, 3, ["id"])(iter(batches)))).to_pylist()
    finally:
        pa.set_memory_pool(old)
    assert pool.max_memory() < vectors.nbytes / 2
    unit = vectors / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    near = np.argsort(-(unit[:40] @ unit.T), axis=1)[:, :3]
    assert sorted((r["query_id"], r["id"]) for r in found) == sorted((q, i) for q in range(40) for i in near[q].tolist())
