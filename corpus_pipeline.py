"""A corpus pipeline over `documents`: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, jaccard, lines, quality, sentencepiece_fst
from graphloom.llm.common import DOCUMENT_COLUMNS, materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.keep_scored(docs.select(DOCUMENT_COLUMNS), forest)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(DOCUMENT_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents of which no line with a word is left; n_chars follows the text."""
    lost = F.col("n_copies") + F.col("n_near") > 0
    found = lines.dedup_lines(docs.select(DOCUMENT_COLUMNS)).where(~lost | F.col("text").rlike(r"[^\x09-\x0D\x20]"))
    chars = F.when(lost, F.char_length("text").cast("bigint"))
    return found.withColumn("n_chars", F.coalesce(chars, "n_chars")).select(DOCUMENT_COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.keep_first(docs.select(DOCUMENT_COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontam.drop_contaminated(docs.select(DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token ids, each encoding decoded again for a check."""
    return sentencepiece_fst.encode_documents(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


#: Boosted trees and byte-pair encoding have no SQL form; tests/llm/test_pipeline.py has a plain version of each stage.
ORACLE_SQL = None
