"""From raw documents to packed sequences: quality, lines, near copies, benchmark passages, packing.

``STAGES`` are applied in order; each works on all rows that its predecessor kept, written as Parquet and
read again, and all but the last return the columns of ``documents``. A null, empty or repeated text takes the
defined result of each stage's operator; an empty table runs through to an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import fm_index, line_dedup, random_index, tensor_minhash, vector_packing
from lintlake.session import ensure_checkpoint_dir

VOCABULARY = "byte_bpe_50k.json"
#: Fewer than packing alone keeps: the executors have run four stages before.
KEPT_PIECES = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to ``labels``, doesn't reject."""
    return random_index.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier, equal or within one word; what loses all lines goes."""
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return tensor_minhash.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; what is nothing else goes."""
    return fm_index.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens."""
    return vector_packing.pack_documents(docs, public_tokenizers.path(VOCABULARY), kept=KEPT_PIECES)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmark),
    ("packing", packing),
]

#: Learnt scores and hashed sketches have no SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows go through the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
