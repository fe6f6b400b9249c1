"""The corpus pipeline: quality rules, near duplicates, personal data, mixing and tokens, each stage over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages are written and
read again between, so each recovers on its own. Nulls, empty texts, ties, repeated rows and empty tables behave as the operators
state: null and empty texts fail the quality rules, so later stages see neither unless they are called alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackweave.llm import bpe, mixing, ngram_join, pii, quality_rules
from trackweave.llm.common import documents, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, without their failing lines."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents at a five-word Jaccard similarity of 0.8 or more."""
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by tags."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    return mixing.resample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row, encoded and decoded."""
    return bpe.round_trip(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mixing", mixture), ("bpe", tokens)]

#: Hashes of texts and token ids decide here, which DuckDB lacks; tests hold every stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
