"""A training-data pipeline from corpus operators; each stage reads what the one before it wrote.

Documents of low quality go first, then exact copies, near copies and documents that quote a benchmark; what is left is
packed into sequences of tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from askahead.llm import decontaminate, exact_dedup, near_copies, packing, quality
from askahead.llm.common import prepare, read_table, stored
from askahead.llm.queries import token_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones of them, does not reject."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    prepare(spark)
    return exact_dedup.keep_last(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    prepare(spark)
    return near_copies.keep_one(docs)


def clean_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of a benchmark item occurs."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, with checksums in place of the ids."""
    prepare(spark)
    return packing.with_checksums(packing.pack(docs, token_file("byte_bpe_50k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", clean_benchmarks),
    ("packing", pack),
]

# Training, fingerprints and tokenization have no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's pieces are returned."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
