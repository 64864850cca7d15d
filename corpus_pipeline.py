"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Rejected, copied and contaminated documents go; secrets are masked; what is left is encoded. All stages but the last return the
columns of documents. Null ids, null texts and repeated rows are treated as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontamination, near_dedup, quality_classifier, secret_scans, sentencepiece_wfst
from graphloom.llm.queries import VOCABULARY
from graphloom.session import materialise, table

#: The models of the first and last stage are not expressible in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8): the one of smallest id."""
    return near_dedup.deduplicate(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that show no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew where a text has changed."""
    return secret_scans.redact(docs, length="n_chars" if "n_chars" in docs.columns else None)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, and whether decoding them gives the text again."""
    return sentencepiece_wfst.encode(docs, sentencepiece_wfst.load(VOCABULARY)).select("doc_id", "n_ids", "ids", "decoded_sha256", "round_trip")


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("secret scan", masked),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
