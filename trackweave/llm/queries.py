"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackweave.llm import bpe, chat, hyperminhash, mixing, nbsvm, ngram_join, pii, quality_rules, revisits, sharding, spelling, telephony, whitening
from trackweave.llm.common import documents


def op1_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return nbsvm.score(docs, nbsvm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(documents(spark, sf_dir))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.pages_query(spark, sf_dir)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.render(chat.rebuild(chat.log_of(rows.unionByName(chat.probe(spark))))))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(documents(spark, sf_dir))


def op7_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.store(documents(spark, sf_dir), files=False)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.components(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": ngram_join.SQL, "op4_revisits": revisits.SQL, "op5_chat": chat.SQL, "op6_line_rules": quality_rules.SQL, "op12_hyperminhash": hyperminhash.SQL}
