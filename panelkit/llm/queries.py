"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, embedding_dedup, hard_negatives, lm, media, mixing, ngram_join, packing, private_spans, quality, repair, sharding, toxicity
from .common import read

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(mixing.mix_sources(read(spark, sf_dir, "documents")))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards go to a folder of their own in the warehouse, which each row names, and stay there."""
    root = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir")).toUri()
    place = f"{root.getScheme() or 'file'}://{root.getAuthority() or ''}{root.getPath()}/panelkit-media/{uuid.uuid4().hex}"
    return media.media_columns(read(spark, sf_dir, "documents"), place)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_rows(read(spark, sf_dir, "conversations"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read(spark, sf_dir, "documents"), n=4, percent=85)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_to_shards(read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), WORD_BPE)


def op11_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans.private_spans(read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(read(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_conversations(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing_sources": op2_mixing_sources,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_media_columns": op4_media_columns,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_sharding": op9_sharding,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_private_spans": op11_private_spans,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op5_chat_formatting": chat.PREFERENCE_SQL,
    "op12_hard_negatives": hard_negatives.MINED_SQL,
    "op13_conversation_repair": repair.REPAIRED_SQL,
}
