"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import (fingerprints, knn_quality, langid, license_scan, line_dedup,
                          line_frequency, merkle, mixing, packing, secret_owners, simhash, spelling,
                          token_counts)
from wardlake.session import scratch_dir, use_local_scratch

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_local_scratch(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sketch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(documents(spark, sf_dir))


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = labels.where(~langid.held_out(F.col("doc_id")))
    rows = knn_quality.predict(docs, knn_quality.train(docs, learned))
    return rows.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score",
                       F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_frequency.quality_rules(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "n_boilerplate", "base_failed", "kept")


def op4_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_owners.secrets(documents(spark, sf_dir))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex",
                       F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_vendor",
                       "n_mixed", "n_copied")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own that is empty at first: every distinct text is encoded once."""
    docs = documents(spark, sf_dir)
    return token_counts.token_counts(docs, tokenizer_path(), f"{scratch_dir(spark)}/token_cache")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"),
                       "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op10_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = langid.predict(docs, model)
    return rows.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"),
                       "lang_pred", "score", "bits_per_byte")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_sketch_fingerprints, op2_quality_knn, op3_quality_rules, op4_secret_owners,
    op5_source_mix, op6_token_counts, op7_simhash, op8_line_dedup,
    op9_best_fit_packing, op10_language_ppm, op11_license_scan, op12_spelling_variants,
    op13_merkle_manifest)}
