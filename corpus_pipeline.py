"""Corpus pipeline: quality classifier, n-gram Jaccard join, benchmark decontamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trajscreen.llm import decontaminate, mixing, ngram_join, quality, sharding
from trajscreen.llm.common import saved

#: SQL can't express the classifier; the stages are tested one by one against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), lambda k: quality.crc_remainder(k, 5) == 0)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of five-word-shingle similarity 0.8 or more."""
    return ngram_join.deduplicated(docs, words=5, percent=80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def keep_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by the probabilities that the raked weights give."""
    return mixing.sample_mixture(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in one of 24 shards."""
    return sharding.assign_shards(docs, [1.0] * 24)


STAGES = [("quality", keep_quality), ("ngram_jaccard", keep_one_of_each), ("decontamination", keep_uncontaminated), ("mixing", keep_mixture), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
