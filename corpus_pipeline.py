"""The corpus pipeline: documents to mixed, sharded training text.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and returns a DataFrame that run() writes as Parquet and reads again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatlake.llm import decontaminate, mixing, sharding, simhash, toxicity
from chatlake.llm.common import read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go."""
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return simhash.keep_one(docs, shingle=3, distance=2)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stand as often as the mix takes their document."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows get size, shard and slot."""
    return sharding.shard_by_bytes(docs, 8)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A trained classifier and XXH64 fingerprints are beyond SQL; tests compare the
#: run with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
