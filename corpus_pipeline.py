"""Corpus pipeline: quality rules, near-dedup, decontamination, secret redaction and byte-level BPE.

Each stage gets all documents that its predecessor kept and returns the columns
of ``documents``, but for the last, which returns tokens.  ``run`` writes what a
stage returns as Parquet below the shared checkpoint folder and reads it again,
so a lost executor never reaches back beyond the stage it runs.  Only the last
stage's files stay.  Checkpoints inside stages go when their tables do, if the
cluster sets ``spark.cleaner.referenceTracking.cleanCheckpoints``.

Defined results, as the operators have them: a null or empty text fails the
quality rules; rows equal in id and text count once, rows of one id with
different texts stay apart, and a null id is never the one that stands for a
group with another; other columns may be null or have any name and pass as
they are; an empty table gives no rows at every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonara.llm import byte_bpe, common, decontamination, near_dedup, quality_rules, registry, secret_scan


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model of these documents finds good."""
    return quality_rules.kept_rows(docs, quality_rules.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of lowest id of each group of near copies."""
    return near_dedup.kept_rows(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    return decontamination.clean_rows(docs, registry.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; ``n_chars`` follows the text."""
    model = secret_scan.train(secret_scan.samples(spark, docs))
    clean = secret_scan.redacted(docs, model)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and digests of the ids and of what they decode to."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(registry.VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("decontamination", decontaminate), ("secret_scan", redact_secrets), ("byte_bpe", encode)]

#: Estimating the label model and the Markov models is iterative; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = registry.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k:  # nothing reads the stage before any more
            common.removed(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
