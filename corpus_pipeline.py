"""From raw documents to packed token sequences: five stages, each on all that the one before has kept.

Null and empty texts have no language and go in the first stage. A stage that is given no rows returns none. Extra
columns of documents are carried to the last stage, which returns pieces instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import centroid_language, minhash, packing, pu_quality, secret_tests
from tallywright.llm.textkit import documents, fold
from tallywright.session import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the language itself is not changed."""
    return centroid_language.keep_known(docs, centroid_language.fit(docs, fold(F.col("doc_id"), 4) != 2))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return pu_quality.keep_good(docs, pu_quality.fit(docs, labels, fold(F.col("doc_id"), 5) != 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least id."""
    return minhash.keep_one(docs, words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind in brackets and n_chars counted anew."""
    clean = secret_tests.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("secret scans", secrets), ("packing", pack)]

#: A trained classifier and a tokenizer are not expressible in SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, "stage")
    return docs
