"""Registered queries of the operators, with their production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversation_dawg, cotrain, hard_negatives, license_index, oracle, packing, pfair, pii, quality_rules, sharding, simhash_vp, suffix_dedup,
               token_orc, vp_search)
from .common import table

END_ID = 2


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "stratum", "level", "certified")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vp_search.nearest(e, e["vec_id"] % 100 == 0).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.scan_licenses(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), END_ID)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.mix(table(spark, sf_dir, "documents")).drop("place")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_files(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), END_ID)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_dawg.repair(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(e["vec_id"] % 7 == 0, (e["label"].cast("long") + 1) % 10).otherwise(e["label"])
    return hard_negatives.mine(e, label, e["vec_id"] % 50 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_nearest, op3_simhash, op4_licenses, op5_packing, op6_sharding, op7_pii, op8_mixing,
    op9_quality_classifier, op10_token_orc,
    op11_suffix_dedup, op12_conversations, op13_hard_negatives, pipeline)}
ORACLE: dict[str, str] = oracle.ORACLE
