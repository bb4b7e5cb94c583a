"""Queries of the corpus operators for __spark_entry__.py: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html, licenses, mixing, packing, passages, quality, sharding, simhash, spanhash
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.interleave(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(conversations.unionByName(own)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(table(spark, sf_dir, "documents")).drop("text_crc32")


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spanhash.compare_edits(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("findings")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_sharding": op3_sharding,
    "op4_mixing_sources": op4_mixing_sources,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_license_scan": op9_license_scan,
    "op10_html_extraction": op10_html_extraction,
}
ORACLE_SQL: dict[str, str] = {
    "op4_mixing_sources": mixing.ORACLE,
    "op5_quality_rules": quality.ORACLE,
}
