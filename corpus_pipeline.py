"""The corpus pipeline: toxic documents out, one of each group of near copies, the mix, ids.

Each stage reads what the one before it wrote. All but the last return the columns of
``documents``; the last returns the ids of every document of the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from agora.llm import bpe, jaccard, mixing, toxicity
from agora.llm.queries import BPE_RANKS
from agora.llm.shared import scratch
from agora.sources.tables import read_table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the classifier chain rejects go."""
    return toxicity.clean_documents(docs, docs, read_table(spark, sf_dir, "labels"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, on five words and a similarity of 0.8: one document of each group stays."""
    return jaccard.one_per_component(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: doc_id, n_tokens, checksums and ids of every document of the mix."""
    return bpe.encode_documents(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [("toxicity", remove_toxic), ("near copies", remove_near_copies), ("mix", mix_sources), ("encode", encode)]

#: A classifier is no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
