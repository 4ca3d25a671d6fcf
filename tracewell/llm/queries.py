"""Registered queries of this subpackage: op1 to op13, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import (
    conversation_repair,
    exact_dedup,
    importance,
    jaccard_join,
    license_scan,
    packing,
    pii,
    piece_codec,
    quality_rules,
    spelling_variants,
    token_counts,
    token_output,
    url_filter,
)
from tracewell.llm.common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    encoded = token_output.encode_tokens(_table(spark, sf_dir, "documents"), token_output.default_tokenizer(), end_id=2)
    token_output.write_tokens(encoded, path)
    return token_output.token_digest(token_output.read_tokens(spark, path))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents")).drop("reason")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), piece_codec.default_model())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip_digest(_table(spark, sf_dir, "documents"), piece_codec.default_model())


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), packing.default_tokenizer(), digest=True)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.url_filter(pages, url_filter.tracked_urls(pages)).drop("canonical", "listed")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(_table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(license_scan.scan_licenses(_table(spark, sf_dir, "documents")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_importance": op5_importance,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_pii": op7_pii,
    "op8_piece_codec": op8_piece_codec,
    "op9_packing": op9_packing,
    "op10_url_filter": op10_url_filter,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_license_scan": op12_license_scan,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL = {
    "op2_quality_rules": quality_rules.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op6_jaccard_join": jaccard_join.SQL,
    "op10_url_filter": url_filter.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
    "op13_spelling_variants": spelling_variants.SQL,
}
