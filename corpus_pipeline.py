"""The corpus pipeline: five operators of the llm subpackage, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; run() writes a stage's rows as Parquet in the shared folder and reads them
again as the next one's docs. All stages but the last return the columns of
documents, the last one returns the encoded texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import decontam, exact_dedup, langid, minhash, spm
from folioscan.llm.common import remove, scoped, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spm.encode(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("benchmark_decontamination", clean),
    ("sentencepiece", encode),
]

#: MinHash groups, the language model and the segmentation can't be said in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written before the next one begins; what a stage broadcast and what it read then go."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{i}-{name}"
        with scoped():
            stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            remove(before)
        docs, before = spark.read.parquet(at), at
    return docs
