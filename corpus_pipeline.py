"""A training corpus from ``documents``: five stages, each an operator of ``seriesframe.llm``.

Every stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``; the last returns the encoded corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesframe.llm import bpe, decontam, jaccard_rtree, robust_quality, secret_crf
from seriesframe.llm.common import read, shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the outlier test keep."""
    return robust_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, and of several rows with that id one."""
    return jaccard_rtree.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text; ``n_chars`` follows where it was known."""
    hidden = secret_crf.redact(docs)
    return hidden.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every document, with their count and the digests of ids and decoded text."""
    return bpe.encode(docs, bpe.default_tokenizer(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("encode", encode),
]

#: Outlier estimates, a trained model and byte-pair encoding have no SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
