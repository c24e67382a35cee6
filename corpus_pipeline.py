"""A corpus from raw documents: language, near-duplicates, benchmark leaks, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldscope.deploy import ready
from fieldscope.durable import folder
from fieldscope.llm import decontam, langid, mixing, sharding, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a clear language go; ``lang`` then holds the language found.

    Null, empty and letterless texts go. Null and repeated ids, repeated rows and very long texts are judged by
    their own whole text. An empty table stays empty; columns stay, whatever their names.
    """
    ready(spark)
    return langid.keep_known(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of smallest id.

    Null and empty texts are one group. Rows are told apart by id and text, so that texts that share an id, or
    have none, are kept; of rows alike in both, one stays. An empty table stays empty; columns stay.
    """
    return simhash.keep_one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own whole text.

    Null and empty texts hold none; null and repeated ids do not matter. Without items nothing goes. An empty
    table stays empty; columns stay.
    """
    return decontam.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it: not at all, once or twice.

    A null source is a source; null and empty texts have no words but are documents. Rows alike in every column
    are counted and their copies added up. An empty table stays empty; columns stay.
    """
    return mixing.take(docs)


def sharding_by_key(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix (see ``shard_documents``): null ids go with id 0, copies stay together."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("mixing_to_targets", mixing_to_targets),
    ("sharding_by_key", sharding_by_key),
]

#: Learned language labels and SimHash cannot be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next input.

    The results lie in a folder that ``durable.clear`` deletes. Hard rows (nulls, empty and very long texts, repeats, ties, clashing names, no rows) go as each stage says.
    """
    place = folder(spark, "pipeline")
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
