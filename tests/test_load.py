"""Loading many files at once: each table as if it were read alone."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from factsheet import clean_table, column_summaries, load_files, table_fingerprint
from factsheet.operators.clean import clean_by_file
from factsheet.sources.csv import read_csv, read_tables
from factsheet.sources.documents import read_docx, scan_documents
from factsheet.sources.vectors import list_stores, read_vectors


def cell(rng, kind):
    return {
        "int": lambda: str(rng.randint(0, 99)),
        "gap": lambda: rng.choice(["", "NA", "7"]),
        "float": lambda: rng.choice(["1.5", "-2e3", "inf", ""]),
        "bool": lambda: rng.choice(["True", "false"]),
        "text": lambda: rng.choice(["a", "b c", '"x\ny"', '"q""r"']),
        "money": lambda: rng.choice(["$ 1-", "2.5 EUR", "n/a", "7%"]),
        "mixed": lambda: rng.choice(["$3", "none here", "x", "y"]),
    }[kind]()


FORMS = (["int", "text"], ["money", "gap", "mixed"], ["bool", "float", "int", "money"])


def many(folder, n, seed=1):
    rng = random.Random(seed)
    paths = []
    for i in range(n):
        kinds = FORMS[i % len(FORMS)]
        header = [f"c{k}" for k in range(len(kinds))]
        if i % 7 == 3:
            header.append("more")
            kinds = [*kinds, "int"]
        rows = [[cell(rng, k) for k in kinds] for _ in range(rng.choice([0, 1, 3, 12, 25]))]
        path = folder / f"t{i}.csv"
        path.write_text("\n".join([",".join(header), *map(",".join, rows)]) + "\n")
        paths.append(str(path))
    return paths


def rows_of(df):
    return sorted(map(str, df.drop("file_id").collect()))


def test_tables_equal_those_read_alone(spark, tmp_path):
    paths = many(tmp_path, 5)
    read = read_tables(spark, paths)
    sources = {r["source"]: r for r in read.sources.collect()}
    for path in paths:
        alone, source = read_csv(spark, path), sources[path]
        assert source["error"] is None and source["num_rows"] == alone.rows.count()
        table = read.tables[source["form"]].filter(F.col("file_id") == source["file_id"])
        assert table.dtypes == alone.rows.dtypes
        assert rows_of(table) == rows_of(alone.rows)
    loaded = load_files(spark, paths)
    for path in paths[1:3]:
        name = path.rsplit("/", 1)[-1]
        alone = clean_table(read_csv(spark, path).rows, exclude=("file_id",))
        assert rows_of(loaded.tables[name]) == rows_of(alone)
        report = loaded.report.filter(F.col("name") == name).first()
        if report["rows_read"]:
            assert loaded.tables[name].dtypes == alone.dtypes
            assert report["fingerprint"] == table_fingerprint(alone.drop("file_id", "_row_index")).first()["fingerprint"]


def jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    counts = []
    for n in (6, 30):
        folder = tmp_path / str(n)
        folder.mkdir()
        paths = []
        for i in range(n):
            path = folder / f"{i}.csv"
            path.write_text(["a,b\n1,x\n2,y\n", "k,v\n1.5,$2\n2.5,$3\n", "z\nTrue\nFalse\n"][i % 3])
            paths.append(str(path))
        counts.append(jobs(spark, f"load-{n}", lambda p=paths, f=folder: load_files(spark, p, str(f / "v"), dimension=8)))
        assert len(list_stores(read_vectors(spark, str(folder / "v" / "tables"))).collect()) == n
    assert counts[1] <= counts[0] + 5 and counts[0] > 5


def test_failures_are_rows(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("a\n1\n")
    (tmp_path / "long.csv").write_text("a,b\n1,2\n1,2,3\n4,5,6,7\n")
    (tmp_path / "none.csv").write_text("\n\n")
    (tmp_path / "head.csv").write_text("x,y\n")
    (tmp_path / "two.csv").mkdir()
    (tmp_path / "two.csv" / "1.csv").write_text("a,b\n1,x\n")
    (tmp_path / "two.csv" / "2.csv").write_text("b,a\ny,2\n")
    (tmp_path / "odd.csv").mkdir()
    (tmp_path / "odd.csv" / "1.csv").write_text("a,b\n1,x\n")
    (tmp_path / "odd.csv" / "2.csv").write_text("a,c\n1,x\n")
    names = ["good", "long", "none", "head", "two", "odd", "missing"]
    read = read_tables(spark, [str(tmp_path / f"{n}.csv") for n in names])
    found = {r["filename"][:-4]: (r["num_rows"], r["error"]) for r in read.sources.collect()}
    assert found == {
        "good": (1, None), "long": (None, "2 rows have more fields than the header's 2"), "none": (None, "no rows"),
        "head": (0, None), "two": (2, None), "odd": (None, "files have different headers"), "missing": (None, "no such file"),
    }
    source = read.sources.filter("filename = 'two.csv'").first()
    two = read.tables[source["form"]].filter(F.col("file_id") == source["file_id"]).orderBy("_row_index").collect()
    assert [(r["_row_index"], r["a"], r["b"]) for r in two] == [(0, 1, "x"), (1, 2, "y")]
    with pytest.raises(ValueError, match="nothing"):
        load_files(spark, [str(tmp_path / "missing.csv"), str(tmp_path / "none.csv"), str(tmp_path / "gone.txt")])


def test_one_broken_document_leaves_the_others(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>good</w:t></w:r></w:p></w:body></w:document>'
    for name, content in (("ok.docx", body), ("xml.docx", "<w:document"), ("empty.docx", None)):
        with zipfile.ZipFile(folder / name, "w") as z:
            z.writestr("word/document.xml" if content else "other.xml", content or "x")
    (folder / "zip.docx").write_text("not an archive")
    (folder / "notes.txt").write_text("notes")
    (folder / "image.png").write_bytes(b"\x89PNG")
    found = scan_documents(spark, str(folder))
    assert sorted((r["filename"], r["text"]) for r in found.rows.collect()) == [("notes.txt", "notes"), ("ok.docx", "good")]
    errors = {r["filename"]: r["error"].split(":")[0] for r in found.failures.collect()}
    assert errors == {"xml.docx": "ParseError", "empty.docx": "KeyError", "zip.docx": "BadZipFile", "image.png": "unsupported file type"}
    assert [r["text"] for r in read_docx(spark, str(folder)).collect()] == ["good"]
    one = scan_documents(spark, str(folder / "notes.txt"), file_id="mine").rows.first()
    assert one["file_id"] == "mine"
    with pytest.raises(ValueError, match="more than one"):
        scan_documents(spark, str(folder), file_id="mine")


def test_summaries_of_many_tables_equal_those_of_each(spark):
    rng = random.Random(2)
    rows = [(f"f{i % 5}", i, rng.choice([None, 1.5, 2.0, 9.0]), rng.choice(["a", "b", "y" * 80, None]), rng.random() < 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "file_id string, _row_index long, x double, s string, ok boolean")
    both = {(r["file_id"], r["column_name"]): r["summary"] for r in column_summaries(df, ["x", "s", "ok"], "_row_index", by="file_id").collect()}
    for f in ("f0", "f3"):
        alone = column_summaries(df.filter(F.col("file_id") == f), ["x", "s", "ok"], "_row_index").collect()
        assert {(f, r["column_name"]): r["summary"] for r in alone} == {k: v for k, v in both.items() if k[0] == f}
    assert len(both) == 15


def test_cleaning_is_decided_for_each_table(spark):
    rows = [("a", 0, "$1", "x1"), ("a", 1, "$2", "y"), ("b", 0, "one", "1"), ("b", 1, "$2", None), ("c", 0, None, "2"), ("c", 1, "no", "3")]
    df = spark.createDataFrame(rows, "file_id string, _row_index long, p string, q string")
    found = {}
    for frame in clean_by_file(df):
        for f in {r["file_id"] for r in frame.select("file_id").distinct().collect()}:
            found[f] = dict(frame.dtypes)["p"], dict(frame.dtypes)["q"]
    expected = {}
    for f in "abc":
        alone = clean_table(df.filter(F.col("file_id") == f), exclude=("file_id",))
        expected[f] = dict(alone.dtypes)["p"], dict(alone.dtypes)["q"]
    assert found == expected and len(set(found.values())) > 1
