"""The corpus operators as queries over the given tables, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askahead.llm import (
    arc_warc,
    conversations,
    decontaminate,
    exact_dedup,
    line_dedup,
    ngram_join,
    packing,
    pii,
    quality,
    secrets,
    simhash,
    sql,
    token_files,
    word_runs,
)
from askahead.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return register


@query("op1_simhash_bktree")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op2_decontaminate", sql.DECONTAMINATE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    ).drop("spans")


def token_file(name: str) -> str:
    """Path of a public tokenizer's vocabulary; applications pass their own path to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return token_files.read_tokens(*token_files.write_tokens(documents, token_file("word_bpe_49k.json")))


@query("op4_line_dedup", sql.LINE_DEDUP)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return packing.with_checksums(packing.pack(documents, token_file("byte_bpe_50k.json")))


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op7_exact_dedup", sql.EXACT_DEDUP)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents")).drop("_rid")


@query("op8_arc_to_warc", sql.WARC)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_warc.pages_through_warc(read_table(spark, sf_dir, "pages"))


@query("op9_secrets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(documents, secrets.train(documents)))


# Stands in for a secret kept outside the code; the query only shows the operator.
DEMO_KEY = b"demonstration key"


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.replace_pii(read_table(spark, sf_dir, "documents"), DEMO_KEY))


@query("op11_conversations", sql.CONVERSATIONS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return conversations.Repair(conversations.damaged(turns)).summary(turns)


@query("op12_word_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digest(word_runs.word_runs(read_table(spark, sf_dir, "documents"), plant=True))


@query("op13_ngram_join", sql.NGRAM_JOIN)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(read_table(spark, sf_dir, "documents"))
