"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.deploy import ready
from fieldscope.llm import bpe, chat, collocations, decontam, fingerprint, hardneg, langid, lmscore, mixing, sharding, simhash, substring, toxicity

#: The conversation that the contract adds to the table.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    # The token counts, which SQL cannot tell, stay in the operator's own output.
    return chat.digest_formatted(chat.format_conversations(turns.union(added))).drop("n_tokens", "loss_tokens")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), shards=16)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_units(_read(spark, sf_dir, "documents")).drop("text_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.label_documents(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_pairs(_read(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lmscore.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scores.withColumns({c: F.round(c, 6) for c in ("loss_target", "loss_background", "score")})


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hardneg.relabelled(_read(spark, sf_dir, "embeddings"))
    return hardneg.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(_read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_fingerprints": op6_fingerprints,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_bpe": op12_bpe,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": chat.DIGEST_SQL,
    "op6_fingerprints": fingerprint.PAIRS_SQL,
    "op8_lm_scoring": lmscore.SCORES_SQL,
    "op9_decontamination": decontam.CONTAINED_SQL,
    "op10_sharding": sharding.SHARDED_SQL,
    "op11_hard_negatives": hardneg.NEGATIVES_SQL,
    "op13_collocations": collocations.PHRASES_SQL,
}
