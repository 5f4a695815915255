"""A corpus pipeline of five stages over `documents`: quality rules, SimHash near-dedup, substring dedup, secret scans,
packing. All stages but the last return the columns of documents; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import quality, secrets, simhash, substrings, tokens
from ledgerloom.llm.common import removed, scratch, shared_folder
from ledgerloom.llm.queries import tokenizer

#: SQL has no XXH64 and no tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules."""
    own = "_ledgerloom_quality"
    return quality.measured(docs, to=own).where(F.col(own)["kept"]).drop(own)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id."""
    return simhash.one_of_each(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words of passages that a smaller doc_id holds too; those left without words go."""
    return substrings.without_repeats(docs)


def unsecret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets replaced by a mark."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in training sequences of 2048 tokens."""
    return tokens.packed(docs, tokenizer("byte_bpe_50k.json"), end_id=1)


STAGES = [("quality", good), ("near_dedup", distinct), ("substring_dedup", unrepeated), ("secrets", unsecret), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet to the shared folder and read again; what a stage left goes once the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/ledgerloom-pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            removed(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return docs
