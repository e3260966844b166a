"""The operators over their whole tables, with the columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsheet.llm import centroids, collocations, decontaminate, language, licences, mixing, near_dup, oracle, passages, pii, quality, secrets, sharding, tokens
from factsheet.llm.common import read_table, shared_path

TOKENIZER = "word_bpe_49k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    tokens.write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer_path(TOKENIZER))
    return tokens.document_digests(tokens.read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    lowest = F.array_min(F.transform("spans", lambda s: s["score"])).alias("lowest_score")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), lowest)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(read_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


#: Shares of the tokens that a mixture should have.
TARGETS = {"good": 0.9, "low": 0.08, "toxic": 0.015, "low_toxic": 0.005}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = mixing.labelled_domains(read_table(spark, sf_dir, "labels"))
    return mixing.mixing_rates(read_table(spark, sf_dir, "documents"), domains, TARGETS)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licences(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("sentences", ",").alias("sentences"), "n_unknown")


#: Shards of the documents.
SHARDS = 24


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(read_table(spark, sf_dir, "documents"), SHARDS)
    crc = F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")).alias("text_crc32")
    return found.select("row.doc_id", "size", crc, F.lit("key").alias("law"), "shard", "slot", F.col("grown").alias("grown_shard"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(read_table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    total = found.centroids.agg(F.sum("inertia")).first()[0]
    sums = found.centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), F.lit(total).cast("bigint").alias("inertia"), digest.alias("centroid_sha256"))
    # One row a centroid.
    return found.assigned.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op10_shared_passages": op10_shared_passages,
    "op11_centroids": op11_centroids,
    "op12_collocations": op12_collocations,
    "op13_sharding": op13_sharding,
    "op2_secrets": op2_secrets,
    "op3_mixing": op3_mixing,
    "op4_token_output": op4_token_output,
    "op5_personal_data": op5_personal_data,
    "op6_licences": op6_licences,
    "op7_language": op7_language,
    "op8_quality": op8_quality,
    "op9_near_duplicates": op9_near_duplicates,
}

ORACLE: dict[str, str] = {
    "op1_decontamination": oracle.OP1,
    "op11_centroids": oracle.op11_sql(),
    "op12_collocations": oracle.OP12,
    "op6_licences": licences.licences_sql(),
    "op8_quality": oracle.OP8,
}
