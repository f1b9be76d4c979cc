"""The thin queries over whole tables, one an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join as _jaccard
from . import language_id, materialise_tokens, mixing, packing, pii, quality_rules, sql, substring_dedup, topk_search, warc
from .tables import table


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_order(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = materialise_tokens.write_shards(table(spark, sf_dir, "documents"))
    back = materialise_tokens.read_shards(manifest)
    return manifest.drop("file", "ids_crc32", "n_bytes").join(back, "slot")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("host_fail_rate")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_topk(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pfair_mixing, op2_language_id, op3_jaccard_join, op4_best_fit_packing, op5_token_shards, op6_quality_rules, op7_warc, op8_pii, op9_substring_dedup, op10_exact_topk)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_jaccard_join": sql.JACCARD,
        "op6_quality_rules": sql.QUALITY.format(host_rate=quality_rules.HOST_RATE),
        "op7_warc": sql.WARC,
        "op9_substring_dedup": sql.SUBSTRINGS,
        "op10_exact_topk": sql.TOPK,
    }
