import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factsheet.llm import sharding
from factsheet.llm.queries import SHARDS, op13_sharding
from tests.conftest import SMALL
from tests.llm.fixtures import SCHEMA, odd_rows


def jump(key, shards):
    shard, ahead = -1, 0
    while ahead < shards:
        shard = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((shard + 1) * (2**31 / ((key >> 33) + 1)))
    return shard


def key_of(doc_id):
    return xxhash.xxh64("" if doc_id is None else f"={doc_id}", seed=42).intdigest()


def placed(spark, keys, shards, more):
    rows = spark.createDataFrame([(str(k),) for k in keys], "k string")
    got = rows.select("k", sharding.jump(F.col("k").cast("decimal(20,0)"), shards, more).alias("s")).collect()
    return {int(r.k): (r.s.shard, r.s.grown) for r in got}


@pytest.mark.parametrize("shards, more", [(1, 0), (1, 1), (2, 1), (24, 1), (100, 0), (1000, 7)])
def test_jumps_equal_the_published_walk(spark, shards, more):
    keys = [0, 1, 42, 256, 0xDEAD10CC, 2**63 - 1, 2**63, 2**64 - 1, *[key_of(i) for i in range(300)]]
    assert placed(spark, keys, shards, more) == {k: (jump(k, shards), jump(k, shards + more)) for k in keys}


def test_rows_that_need_many_jumps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "JUMPS", 2)
    keys = [key_of(i) for i in range(200)]
    assert placed(spark, keys, 50, 1) == {k: (jump(k, 50), jump(k, 51)) for k in keys}


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(1, 60))
def test_one_more_shard_takes_rows_only_into_itself(key, shards):
    assert jump(key, shards + 1) in (jump(key, shards), shards)


def expected(rows):
    out = Counter()
    for doc_id, text in rows:
        data = (text or "").encode()
        out[doc_id, len(data) + 8, zlib.crc32(data), "key", jump(key_of(doc_id), SHARDS), jump(key_of(doc_id), SHARDS + 1)] += 1
    return out


def check(found, rows):
    got = found.collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == expected(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_equals_brute_force(spark, table):
    check(op13_sharding(spark, SMALL), [(r.doc_id, r.text) for r in table("documents").select("doc_id", "text").collect()])


def test_odd_rows_keep_their_columns(spark, tmp_path):
    schema = SCHEMA.replace("h long", "shard string").replace("k long", "`at` long").replace("words", "size")
    docs = spark.createDataFrame([(*r[:5], "h", *r[6:]) for r in odd_rows()], schema)
    found = sharding.sharded(docs, 3)
    digest = found.select("row.doc_id", F.coalesce(F.octet_length("row.text"), F.lit(0)).alias("bytes"), "size", "shard", "slot", "row").collect()
    assert Counter(tuple(r.row) for r in digest) == Counter(tuple(r) for r in docs.collect())
    assert all(r["size"] == r["bytes"] + 8 for r in digest)
    assert len({(r.shard, r.slot) for r in digest}) == len(digest)
    # One key, one shard, whatever the rows hold.
    assert all(len({r.shard for r in digest if r.doc_id == k}) == 1 for k in {r.doc_id for r in digest})


def test_hot_key_is_cut_into_many_tasks(spark, tmp_path):
    docs = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        sharding.write_shards(docs.repartition(16), str(tmp_path / "s"), 4)
        found = sharding.read_shards(spark, str(tmp_path / "s"), docs)
        assert len(list((tmp_path / f"s/rows/shard={jump(key_of(7), 4)}").glob("*.parquet"))) > 4
        slots = found.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m"), F.min("slot").alias("l")).collect()
        assert all(s.n == s.d == s.m + 1 and s.l == 0 for s in slots) and sum(s.n for s in slots) == 40_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)


def test_shard_folder_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    sharding.write_shards(docs, str(tmp_path / "s"), 5)
    one = sharding.read_shards(spark, str(tmp_path / "s"), docs).filter("shard = 2")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan
    assert {r.row.doc_id for r in one.collect()} == {r[0] for r in odd_rows() if jump(key_of(r[0]), 5) == 2}
    assert sharding.sharded(docs.limit(0), 5).count() == 0
    plan = op13_sharding(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
