"""From raw documents to token ids: five operators, one after the other.

Toxic documents go, exact copies go, one document of each group of near copies stays, sources are mixed to their
target weights, and what is left is encoded. Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written as Parquet and read again as input of the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import bpe, exact, mixing, simhash, toxicity
from tabloom.llm.common import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. The model is fitted on labelled rows of the documents at hand."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash fingerprints at three or fewer differing bits the document with the smallest id stays."""
    return simhash.simhash_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked by decoding: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # The executors' heaps are as large as the stages before made them, so the workers keep smaller tables here.
    return bpe.roundtrip(docs, path, public_tokenizers.PATTERN, max_states=40_000, max_pieces=120_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

# The transducer, the fitted model and components have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
