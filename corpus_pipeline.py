"""The corpus pipeline: documents through quality rules, near-dedup, benchmark decontamination and redaction into packed sequences.

Every stage but the last returns the columns of documents, for all that its predecessor kept. Between
stages the rows are written as Parquet in the shared folder and read again, so a lost executor costs
at most a part of one stage; a stage's scratch tables and its predecessor's rows are deleted once its
own are written.

Defined results, of every stage: null texts count as empty (the quality rules reject them); null ids
pass through; rows of one id are one document, of which near-dedup keeps one row; texts of any length
are handled whole; empty tables give no rows; columns of any other name are carried along to the last
stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, near, packing, quality, secrets
from tessera.llm.frames import discard, table, tidy


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of policy v1 pass."""
    return quality.passing(docs, "v1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return near.one_of_each(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in windows of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts redacted."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scans", secret_scans), ("packing", pack)]

#: Sketches, decoding layers and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        new: list[str] = []
        with tidy(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), new)
        discard(spark, old)
        old = new
    return STAGES[-1][1](spark, docs, sf_dir)
