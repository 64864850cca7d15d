"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontamination, html_extraction, language_id, near_dedup, quality_classifier, quality_rules, secret_scans, sentencepiece_wfst, substring_dedup, url_filters
from graphloom.llm.statistics import COUNTS
from graphloom.session import table


#: Vocabulary of the registered query; any SentencePiece model's path may be given to the operator.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *COUNTS, "base_failed", "kept", "score")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_wfst.encode(table(spark, sf_dir, "documents"), sentencepiece_wfst.load(VOCABULARY))
    return encoded.select("doc_id", "n_ids", "ids", "decoded_sha256", "round_trip")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_dedup": op3_near_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_secret_scans": op10_secret_scans,
}
ORACLES = {
    "op3_near_dedup": near_dedup.oracle(),
    "op4_url_filters": url_filters.oracle(),
    "op5_substring_dedup": substring_dedup.oracle(),
    "op9_decontamination": decontamination.oracle(),
    "op10_secret_scans": secret_scans.oracle(),
}
