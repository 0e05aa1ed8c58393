"""A training corpus from documents: the stages in order, and the whole of them.

Each stage works on what the one before it kept and is written as Parquet between; a stage's
own tables, and what it read, go as soon as it is written. The last returns the packed pieces
with their ids; all others return documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadweave.llm import stages
from leadweave.llm.common import release, settled
from leadweave.llm.packing import pack

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.repeat_to_weights(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: SQL has neither the trained field nor the tokenizer nor the search for fills.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = settled(lambda stage=stage, docs=before: stage(spark, docs, sf_dir), name.split()[0].lower())
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
