"""One registered query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, kernels, language_id, license_scan, lm_scoring, oracles, packing, quality, simhash, substring_dedup, suffix_dedup, token_alignment, token_output, topk_search, whitening


def held_out(remainder: int = 0) -> Column:
    """Rows of a contract that nothing is learned from: those whose crc32 of doc_id leaves this remainder."""
    return kernels.remainder() == remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language_id.fit_dictionaries(docs, ~held_out())
    return language_id.identify(docs, dictionaries).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.score_texts(table(spark, sf_dir, "documents"), ~held_out(1))
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, 2048)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out())


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_token_output, op4_license_scan, op5_simhash, op6_topk_search, op7_lm_scoring, op8_decontamination, op9_packing, op10_quality, op11_suffix_dedup, op12_token_alignment, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": oracles.SUBSTRING_DEDUP, "op4_license_scan": oracles.LICENSE_SCAN, "op6_topk_search": oracles.TOP_K, "op8_decontamination": oracles.DECONTAMINATION, "op11_suffix_dedup": oracles.SUFFIX_DEDUP}
