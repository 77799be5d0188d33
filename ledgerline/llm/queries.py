"""The queries of this subpackage: each reads the tables of a folder and returns one operator's whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import collocations, decontaminate, fertility, fingerprints, language, language_model, licenses, ngram_join, packing, passages, quality, resampling, secrets
from ledgerline.llm.common import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(read(spark, sf_dir, "documents"))


def op11_phrase_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"))


def op12_target_distribution_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.rules(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_license_scans, op2_lm_scoring, op3_benchmark_decontamination, op4_document_fingerprints, op5_language_id, op6_best_fit_packing, op7_quality_classifier, op8_secret_scans, op9_ngram_jaccard_join, op10_substring_dedup, op11_phrase_collocation_mining, op12_target_distribution_importance_resampling, op13_quality_rules)}
ORACLE_SQL: dict[str, str] = {"op1_license_scans": licenses.scan_sql(), "op11_phrase_collocation_mining": collocations.mine_sql()}
