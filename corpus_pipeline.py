"""A corpus pipeline of five stages: each takes the documents that the one before kept.

Stages: language identification (documents without a recognised language go), near-duplicates (one of
each group stays), benchmark decontamination (contaminated documents go), mixing sources to target
weights (documents are repeated or left out by their source's rate), sharding.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from furrow.llm import decontam, lang_id, mixing, sharding, simhash
from furrow.llm.common import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.keep_known_languages(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [("language ID", language), ("near-duplicates", near_dedup), ("decontamination", decontaminate), ("source mixing", mix), ("sharding", shard)]

#: The stages fit models and hash with functions that SQL doesn't have; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
