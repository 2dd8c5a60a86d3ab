"""A corpus from documents to token ids: language, near-duplicates, secrets, mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import op3_bpe, op6_language, op7_minhash, op8_secrets, op10_mixing
from ledgerloom.llm.common import materialize

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: No stage has an equal in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; lang is that language."""
    return op6_language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return op7_minhash.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return op8_secrets.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    return op10_mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, digests and position in the mix of each document."""
    return op3_bpe.encode_documents(op10_mixing.positions(docs), WORD_BPE, "position")


STAGES = [("language_id", language_id), ("minhash_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("bpe", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn on documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
