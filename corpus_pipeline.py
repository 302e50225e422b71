"""A corpus pipeline of operators of palimpsest.llm: quality rules, one document of each group of near
duplicates, removal of repeated substrings, mixing to source weights, and byte-level BPE.

Each stage takes (spark, docs, sf_dir) and all its predecessor kept; all but the last return the columns
of documents. A null text stays null; every stage takes an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import byte_bpe, jaccard_join, mixing, quality_rules, suffix_dedup
from palimpsest.llm.queries import tokenizer
from palimpsest.llm.shared import saved


def drop_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words a shingle, a similarity of 0.8; the least id of each group stays."""
    return jaccard_join.one_of_each(docs, words_each=5, percent=80)


def remove_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No source twice as often repeated as another; every document at least once."""
    return mixing.mixed_rows(docs, repetition_limit=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(docs, *tokenizer())


STAGES = [
    ("quality rules", drop_outliers),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", remove_repeated_substrings),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]
#: Minimum covariance determinants and byte-level BPE have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each over what the one before it wrote to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
