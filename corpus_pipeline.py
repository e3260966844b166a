"""From documents to token files: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written and reread as the next one's
docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsheet.llm import decontaminate, language, mixing, near_dup, tokens
from factsheet.llm.common import read_table, shared_path, stored
from factsheet.llm.queries import TARGETS, TOKENIZER


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts."""
    return language.keep_identified(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id."""
    return near_dup.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate says, so that expected domain tokens meet the targets."""
    domains = mixing.labelled_domains(read_table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, mixing.mixing_rates(docs, domains, TARGETS))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token files in the shared folder, and what they hold of each document."""
    path = shared_path(spark, "tokens")
    tokens.write_tokens(docs, path, tokenizer_path(TOKENIZER))
    return tokens.document_digests(tokens.read_tokens(spark, path)).withColumn("path", F.lit(path))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("mixing to target weights", mix_sources),
    ("token-ID output", write_token_ids),
]

#: Trained models, alignment and fitted rates can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs.drop("path")
