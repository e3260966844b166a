import json
import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from factsheet import ingest_documents, ingest_table, load_files
from factsheet.functions.session import staging_path
from factsheet.sources.csv import header_names, read_csv
from factsheet.sources.documents import find_document, read_documents, read_docx, read_txt
from factsheet.sources.sinks import write_csv, write_json
from factsheet.sources.vectors import add_vectors, list_stores, read_vectors


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def rows_of(table):
    return [tuple(r) for r in table.rows.orderBy("_row_index").drop("file_id", "_row_index").collect()]


def test_header_names():
    assert header_names("a,b,a,a,,SL.NO,") == ["a", "b", "a.1", "a.2", "Unnamed: 4", "SL.NO", "Unnamed: 6"]
    assert header_names('﻿"x, y",z') == ["x, y", "z"]


def test_types(spark, tmp_path):
    text = "SL.NO,gap,x,ok,maybe,day,t,none\n1,1,1e3,True,True,2024-01-01, a ,\n2,NA,-.5,False,,2024-01-02,1d,\n3,3,inf,TRUE,true,x,3,\n"
    table = read_csv(spark, put(tmp_path / "t.csv", text), "f")
    assert dict(table.rows.dtypes) == {
        "file_id": "string", "_row_index": "bigint", "SL.NO": "bigint", "gap": "double", "x": "double", "ok": "boolean",
        "maybe": "string", "day": "string", "t": "string", "none": "double",
    }
    assert rows_of(table) == [
        (1, 1.0, 1000.0, True, "True", "2024-01-01", " a ", None),
        (2, None, -0.5, False, None, "2024-01-02", "1d", None),
        (3, 3.0, float("inf"), True, "true", "x", "3", None),
    ]
    assert [tuple(r) for r in table.files.collect()] == [("f", "t.csv", 3, 8)]


def test_quotes_newlines_short_rows_and_duplicates(spark, tmp_path):
    text = 'a,a,c\n"x ""q"" y","line 1\nline 2",1\nshort,row\n"",NULL,3\n'
    assert rows_of(read_csv(spark, put(tmp_path / "q.csv", text))) == [
        ('x "q" y', "line 1\nline 2", 1.0), ("short", "row", None), (None, None, 3.0),
    ]
    assert read_csv(spark, str(tmp_path / "q.csv")).rows.columns[2:] == ["a", "a.1", "c"]


def test_only_files_with_quoted_newlines_are_read_whole(spark, tmp_path):
    put(tmp_path / "d" / "one +1.csv", 'a,b\n1,"x\ny"\n2,z\n')
    put(tmp_path / "d" / "two.csv", "a,b\n3,w\n4,v\n5,u\n")
    table = read_csv(spark, str(tmp_path / "d"))
    got = sorted((r["file_id"][:3], r["_row_index"], r["a"], r["b"]) for r in table.rows.collect())
    assert got == [("one", 0, 1, "x\ny"), ("one", 1, 2, "z"), ("two", 0, 3, "w"), ("two", 1, 4, "v"), ("two", 2, 5, "u")]
    assert sorted((r["filename"], r["num_rows"]) for r in table.files.collect()) == [("one +1.csv", 2), ("two.csv", 3)]


def test_row_positions_across_splits(spark, tmp_path):
    n = 20000
    path = put(tmp_path / "big.csv", "i,s\n" + "".join(f"{i},{'x' * 20}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = read_csv(spark, path).rows
        assert rows.filter(F.col("_row_index") != F.col("i")).count() == 0
        assert rows.agg(F.count_distinct("_row_index")).first()[0] == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_row_positions_by_shuffle_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("factsheet.sources.csv.BROADCAST_SPLITS", 0)
    path = put(tmp_path / "t.csv", "i\n" + "".join(f"{i}\n" for i in range(100)))
    assert read_csv(spark, path).rows.filter(F.col("_row_index") != F.col("i")).count() == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q"x', "a,b\nc", [1.5, 2.0])], "i bigint, s string, t string, l array<double>")
    write_csv(df, str(tmp_path / "out"))
    assert rows_of(read_csv(spark, str(tmp_path / "out"))) == [(1, 'q"x', "a,b\nc", "[1.5,2.0]")]


def test_json_keeps_missing_cells(spark, tmp_path):
    write_json(spark.createDataFrame([(1, None)], "i int, s string"), str(tmp_path / "out"))
    line = "".join(f.read_text() for f in (tmp_path / "out").glob("part-*.json"))
    assert json.loads(line) == {"i": 1, "s": None}


def test_txt(spark, tmp_path):
    put(tmp_path / "d" / "my notes.TXT", "a\r\nb\rc".encode() + b"\xff\xe2\x82" + "é\n".encode())
    put(tmp_path / "d" / "ok.txt", "� stays")
    rows = {r["filename"]: r for r in read_txt(spark, str(tmp_path / "d")).collect()}
    assert rows["my notes.TXT"]["text"] == "a\nb\ncé\n" and rows["my notes.TXT"]["document_type"] == "txt"
    assert rows["my notes.TXT"]["file_id"].startswith("doc_my_notes_")
    assert rows["ok.txt"]["text"] == "� stays"


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>')
    return str(path)


def p(*runs):
    return "<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{r}</w:t></w:r>' for r in runs) + "</w:p>"


def tc(text, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}</w:tc>"


def test_docx(spark, tmp_path):
    table = (
        "<w:tbl>"
        + f"<w:tr>{tc('a')}{tc(' ')}{tc('b', '<w:vMerge w:val=%srestart%s/>' % (chr(34), chr(34)))}</w:tr>"
        + f"<w:tr>{tc('wide', '<w:gridSpan w:val=%s2%s/>' % (chr(34), chr(34)))}{tc('', '<w:vMerge/>')}</w:tr>"
        + f"<w:tr>{tc('')}{tc('')}{tc('')}</w:tr></w:tbl>"
    )
    tabs = "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/><w:t>z</w:t></w:r></w:p>"
    link = "<w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>"
    docx(tmp_path / "d" / "r.docx", p("Hello ", "world") + p(" ") + tabs + table + link)
    r = read_docx(spark, str(tmp_path / "d")).first()
    assert r["text"] == "Hello world\nx\ty\nz\nlink\n\nTables:\na | b\nwide | wide | b"
    assert r["document_type"] == "docx" and r["file_id"].startswith("doc_r_")


def test_documents_by_suffix(spark, tmp_path):
    put(tmp_path / "d" / "a.txt", "Q1: why?\n\nAns: so")
    docx(tmp_path / "d" / "sub" / "b.docx", p("text"))
    docs = read_documents(spark, str(tmp_path / "d")).rows
    assert sorted((r["filename"], r["text"]) for r in docs.collect()) == [("a.txt", "Q1: why?\n\nAns: so"), ("b.docx", "text")]
    put(tmp_path / "d" / "c.pdf", "x")
    with pytest.raises(ValueError, match="pdf"):
        read_documents(spark, str(tmp_path / "d"))


def test_ingest_documents_stores_vectors(spark, tmp_path):
    put(tmp_path / "d" / "a.txt", "Q1: why?\n\nAns: so")
    put(tmp_path / "d" / "b.txt", "plain text")
    store = str(tmp_path / "vectors")
    loaded = ingest_documents(spark, str(tmp_path / "d"), store, dimension=16, buckets=4)
    meta = {r["filename"]: r for r in loaded.metadata.collect()}
    assert meta["a.txt"]["num_qa_pairs"] == 1 and not meta["b.txt"]["has_questions"]
    fid = meta["a.txt"]["file_id"]
    vectors = read_vectors(spark, store, fid)
    assert sorted(r["chunk_type"] for r in vectors.collect()) == ["qa_pair", "text"]
    assert find_document(loaded.data, fid).first()["filename"] == "a.txt"
    assert [r["num_vectors"] for r in list_stores(read_vectors(spark, store)).collect()] == [2, 1]


def test_ingest_table_cleans_and_stores_vectors(spark, tmp_path):
    path = put(tmp_path / "my prices.csv", "item,price\npen,$ 1-\ncup,2.5\n")
    store = str(tmp_path / "vectors")
    loaded = ingest_table(spark, path, "f", store, dimension=16, buckets=4)
    assert [tuple(r) for r in loaded.data.orderBy("_row_index").collect()] == [("f", 0, "pen", -1.0), ("f", 1, "cup", 2.5)]
    meta = loaded.metadata.first()
    assert meta["filename"] == "my prices.csv" and meta["numeric_columns"] == ["price"] and meta["num_rows"] == 2
    units = read_vectors(spark, store, "f").collect()
    assert sorted((r["row_idx"], r["column_name"]) for r in units) == [(-1, "item"), (-1, "price"), (0, None), (1, None)]


def test_vector_table(spark, tmp_path):
    store = str(tmp_path / "v")
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0])], "file_id string, embedding array<float>")
    add_vectors(df, store, 2, buckets=4)
    # Loading a file again replaces its vectors, whatever the number of buckets was.
    add_vectors(df.filter("file_id = 'a'"), store, 2, buckets=8)
    got = [[round(x, 6) for x in r["embedding"]] for r in read_vectors(spark, store, "a").collect()]
    assert got == [[0.6, 0.8]] and read_vectors(spark, store).count() == 2
    assert read_vectors(spark, store, "b").first()["embedding"] == [0.0, 0.0]
    plan = read_vectors(spark, store, "a")._jdf.queryExecution().executedPlan().toString()
    assert "file_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(file_id,a)" in plan
    with pytest.raises(Exception, match="dimension"):
        add_vectors(spark.createDataFrame([("a", [1.0])], df.schema), store, 2, buckets=4)
    with pytest.raises(Exception, match="dimension"):
        add_vectors(spark.createDataFrame([("a", None)], df.schema), store, 2, buckets=4)


def test_load_files_reports_failures(spark, tmp_path):
    paths = [
        put(tmp_path / "a b.csv", "n,s\n1-,x\n2,y\n"),
        put(tmp_path / "t.txt", "text"),
        put(tmp_path / "bad.pdf", "x"),
        str(tmp_path / "missing.csv"),
    ]
    loaded = load_files(spark, paths, str(tmp_path / "v"), dimension=8)
    report = {r["name"]: r for r in loaded.report.collect()}
    assert {n: (r["status"], r["type"]) for n, r in report.items()} == {
        "a b.csv": ("success", "csv"), "t.txt": ("success", "document"),
        "bad.pdf": ("error", "document"), "missing.csv": ("error", "csv"),
    }
    assert "pdf" in report["bad.pdf"]["error"]
    assert (report["a b.csv"]["rows_read"], report["a b.csv"]["columns_cleaned"]) == (2, 2)
    assert [r["n"] for r in loaded.tables["a b.csv"].orderBy("_row_index").collect()] == [-1.0, 2.0]
    assert list_stores(read_vectors(spark, str(tmp_path / "v" / "tables"))).first()["file_id"].startswith("a_b_")
    with pytest.raises(ValueError):
        load_files(spark, paths[2:])


def test_files_of_one_name_stay_two(spark, tmp_path):
    for folder, text in (("x", "n\n1\n"), ("y", "n\n2\n3\n")):
        (tmp_path / folder).mkdir()
        put(tmp_path / folder / "s.csv", text)
    paths = [str(tmp_path / f / "s.csv") for f in ("x", "y")]
    loaded = load_files(spark, paths, str(tmp_path / "v"), dimension=8)
    assert sorted(r["rows_read"] for r in loaded.report.collect()) == [1, 2] and set(loaded.tables) == set(paths)
    assert len({r["file_id"] for r in loaded.report.collect()}) == 2
    assert [r["num_vectors"] for r in list_stores(read_vectors(spark, str(tmp_path / "v" / "tables"))).collect()].__len__() == 2


def test_csv_headers_of_several_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    put(tmp_path / "d" / "1.csv", "\na,b\n1,x\n")
    put(tmp_path / "d" / "2.csv", "b,a\ny,2\n")
    rows = read_csv(spark, str(tmp_path / "d"), "f").rows.orderBy("_row_index").collect()
    assert [tuple(r) for r in rows] == [("f", 0, 1, "x"), ("f", 1, 2, "y")]
    put(tmp_path / "d" / "3.csv", "a,c\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        read_csv(spark, str(tmp_path / "d"))


def test_csv_header_over_two_lines_and_long_rows(spark, tmp_path):
    rows = read_csv(spark, put(tmp_path / "h.csv", '"a\nb",c,d\n1,2,3\n')).rows
    assert rows.columns[2:] == ["a\nb", "c", "d"] and rows.first()[2:] == (1, 2, 3)
    with pytest.raises(ValueError, match="more fields"):
        read_csv(spark, put(tmp_path / "l.csv", "a,b\n1,2\n1,2,3\n"))


def test_csv_names_that_clash(spark, tmp_path):
    rows = read_csv(spark, put(tmp_path / "n.csv", "Id,id,file_id,_row_index\n1,2,3,4\n"), "f").rows
    assert rows.columns == ["file_id", "_row_index", "Id", "id.1", "file_id.1", "_row_index.1"]
    assert tuple(rows.first()) == ("f", 0, 1, 2, 3, 4)


def test_staging_needs_a_shared_folder_on_a_cluster():
    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            staging_path(session(master), "x")
    assert staging_path(session("yarn", "hdfs://n/c/"), "x").startswith("hdfs://n/c/factsheet/x-")
    assert staging_path(session("local[2]"), "x")
