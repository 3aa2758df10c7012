"""The registered queries of the corpus operators: thin wrappers that derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm import divergence, embed_dedup, license_scan, media, mixing, packing, quality, set_join, suffix_dedup, tokens, topk, toxicity
from weftnet.llm.common import table


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(table(spark, sf_dir, "documents"), tokenizer()))


def op3_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op4_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join(table(spark, sf_dir, "documents"))


def op5_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(table(spark, sf_dir, "documents"))
    pages = media.sequences(media.document_pages(stored), "key")
    placed = media.resolve(pages, media.features(stored), "key")
    return placed.select(F.col("key").alias("doc_id"), F.col("caption").cast("long").alias("n_bytes"), *media.FEATURES.names[1:])


def op7_window_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_template_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sorted_projections": op1_sorted_projections,
    "op2_token_files": op2_token_files,
    "op3_bin_completion": op3_bin_completion,
    "op4_set_relation_join": op4_set_relation_join,
    "op5_fourier_quality": op5_fourier_quality,
    "op6_media_sequences": op6_media_sequences,
    "op7_window_toxicity": op7_window_toxicity,
    "op8_suffix_runs": op8_suffix_runs,
    "op9_source_mix": op9_source_mix,
    "op10_template_licenses": op10_template_licenses,
    "op11_source_divergence": op11_source_divergence,
    "op12_maxscore": op12_maxscore,
}

ORACLES: dict[str, str] = {
    "op9_source_mix": mixing.mix_sql(),
    "op11_source_divergence": divergence.audit_sql(),
    "op12_maxscore": topk.top_k_sql(),
}
