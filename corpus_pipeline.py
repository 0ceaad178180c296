"""A corpus pipeline over ``documents``: each stage works on what the one before it kept, written as Parquet and read again.

1. language: texts in no learned language go. 2. near_dedup: one document of each near-duplicate group stays (shingles
of five words, similarity 0.8). 3. decontaminate: documents that hold a benchmark window go. 4. secrets: every secret's
span is masked. 5. bpe: the documents as token ids, with digests of the ids and the decoded text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tierline.llm import bpe_chunks, hamming_join, ppm, secret_ledger, suffix_match
from tierline.llm.common import scratch_dir, table

#: The stages' results depend on trained models, hashes and a tokenizer: no SQL states them.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ppm.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hamming_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_match.remove(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_ledger.redact(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode(docs, public_tokenizers.path(bpe_chunks.VOCABULARY))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
