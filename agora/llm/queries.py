"""Registered queries of the training-data operators, by the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.sources.tables import read_table

from . import (alignment, bpe, embedding_dedup, fingerprints, jaccard, lm, merkle, mixing, neighbours, quotation, sharding, token_counts, toxicity)

BPE_RANKS, BPE_FILE, PIECE_MODEL = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"), 8)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), 0.93)


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.reply_order(read_table(spark, sf_dir, "conversations"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS),
                                public_tokenizers.PATTERN, with_ids=False)


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), 10, 100)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"), 3, 90).select(
        "doc_id", "n_shingles", "component_id")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
                        F.col("taken").cast("long").alias("taken"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL), 4096)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"), merkle.one_in_five()).drop("path")


def op12_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE),
                                     public_tokenizers.PATTERN, public_tokenizers.path(PIECE_MODEL))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_sharding, op2_embedding_dedup, op3_quotation_linking, op4_toxicity, op5_class_lm, op6_byte_bpe,
    op7_nn_descent, op8_jaccard_join, op9_source_mix, op10_token_counts, op11_merkle_manifest, op12_weighted_fingerprints,
    op13_token_alignment)}

ORACLES: dict[str, str] = {"op2_embedding_dedup": embedding_dedup.ORACLE, "op8_jaccard_join": jaccard.ORACLE,
                           "op9_source_mix": mixing.ORACLE, "op11_merkle_manifest": merkle.ORACLE}
