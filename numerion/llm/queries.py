"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from numerion.llm import bpe_chunks, centroids, chat_quotes, divergence, langid, license_scan, minhash, mixing, oracles, quality, simhash, suffix_dedup, token_counts, topk
from numerion.llm.common import documents, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir))


def op2_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.base(documents(spark, sf_dir))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.digests(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def whole_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.whole_mix(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).drop("clean_text")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), ngram=2)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op13_laesa_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_chat_quotes": op2_chat_quotes,
        "op3_token_counts": op3_token_counts,
        "op4_license_scan": op4_license_scan,
        "license_base": license_base,
        "op5_topk": op5_topk,
        "op6_bpe_chunks": op6_bpe_chunks,
        "op7_langid": op7_langid,
        "op8_mixing": op8_mixing,
        "whole_mix": whole_mix,
        "op9_quality_rules": op9_quality_rules,
        "op10_minhash": op10_minhash,
        "op11_simhash": op11_simhash,
        "op12_source_divergence": op12_source_divergence,
        "op13_laesa_centroids": op13_laesa_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": oracles.SUFFIX_DEDUP,
        "op2_chat_quotes": oracles.CHAT_QUOTES,
        "license_base": license_scan.BASE_ORACLE,
        "op5_topk": topk.ORACLE,
        "op8_mixing": mixing.ORACLE,
        "whole_mix": mixing.WHOLE_ORACLE,
        "op9_quality_rules": quality.ORACLE,
        "op10_minhash": oracles.NEAR_DUPLICATES,
        "op12_source_divergence": divergence.ORACLE,
        "op13_laesa_centroids": centroids.ORACLE,
    }
