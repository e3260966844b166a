import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from factsheet.llm import collocations
from factsheet.llm.oracle import OP12
from factsheet.llm.queries import op12_collocations
from tests.conftest import SMALL
from tests.llm.fixtures import SCHEMA, odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, first):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, 5):
                count[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        ranked = []
        for p, a in candidates.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def got(found):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect())


def odd_docs():
    rng = random.Random(2)
    common = ["the", "of", "Ärger", "ÄRGER", "x y", "“quoted”", "end", "a-b", "'"]
    texts = [(" ".join(rng.choice(common) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "und", ""])) for _ in range(200)]
    texts += [("New York City hall. New York City, new\tyork  city;NEW YORK city\x0bNew York", "en")] * 12
    texts += [(None, None), ("", "en"), ("...\n\r!?", "xx"), (" \t ", "yy"), ("one", "zz"), ("w " * 30_000, "de")]
    texts += [("\x00 \x01 .   tail   tail", "en")] * 9
    return texts


@pytest.mark.parametrize("cut_rows", [collocations.CUT_ROWS, 0])
@pytest.mark.parametrize("least, first", [(8, 2000), (30, 5)])
def test_equals_brute_force(spark, least, first, cut_rows):
    texts = odd_docs()
    docs = spark.createDataFrame([(t, lang, 1, "x", 2) for t, lang in texts], "text string, lang string, w1 int, phrase string, level int")
    expected = brute(texts, least, first)
    assert got(collocations.collocations(docs, least, first, cut_rows=cut_rows)) == expected and len(expected) > 5


def test_odd_rows_and_empty_table(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    assert got(collocations.collocations(docs, 2, 50)) == brute([(r[1], r[2]) for r in odd_rows()], 2, 50)
    assert got(collocations.collocations(docs.limit(0))) == []


def test_products_pass_64_bits(spark):
    rows = [("en", "a b", 2, 9 * 10**17), ("en", "a", 1, 4 * 10**18), ("en", "b", 1, 9 * 10**17), ("en", "a b c", 3, 8 * 10**17), ("en", "b c", 2, 8 * 10**17), ("en", "c", 1, 8 * 10**17)]
    found = spark.createDataFrame(rows, "lang string, phrase string, k int, f long")
    score = {r.phrase: (r.l, r.r, r.score) for r in collocations.scored(found).collect()}
    assert score["a b"] == (4 * 10**18, 9 * 10**17, 2_000_000 * 9 * 10**17 // (49 * 10**17))
    assert score["a b c"] == (4 * 10**18, 8 * 10**17, 2_000_000 * 8 * 10**17 // (48 * 10**17))


def test_query_equals_sql_and_brute_force(spark, table):
    rows = [(r.text, r.lang) for r in table("documents").select("text", "lang").collect()]
    found = got(op12_collocations(spark, SMALL))
    assert found == brute(rows, 30, 2000) and found
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    assert sorted(con.sql(OP12).fetchall()) == found


def test_one_explosion_and_a_rollup(spark, table):
    rows = collocations.pieces(table("documents"))
    plan = collocations.windows(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "Exchange" not in plan
    counted = collocations.counted_windows(collocations.windows(rows))
    assert counted.columns == ["lang", *collocations.COLUMNS, "f"] and "Window" not in counted._jdf.queryExecution().executedPlan().toString()
