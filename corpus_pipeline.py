"""A corpus from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder, deletes what
the stage wrote on its way, and hands the reread table to the next stage. All but the last return the columns of documents; the last returns the token ids of each
row that the mix takes, as little-endian unsigned 32-bit integers, with their number and digests. Rows of one document lie
together after the mix and are encoded once.

Defined cases: null and empty texts fail the quality rules, so the later stages get none from them, and stand them if they are called
alone; a null id is kept apart from all others; very long texts are taken whole; equal rows are copies of each other, of which all but
those with the smallest id go; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oakgraph.llm import bpe, mixing, near_dups, pii, quality
from oakgraph.runtime import small_batches, table, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    small_batches(spark)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays, that with the smallest id."""
    return near_dups.keep_one(docs, shingle_words=5)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked in the texts."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of their decoding."""
    small_batches(spark)
    return bpe.digests(docs, VOCABULARY, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", sanitise),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: DuckDB has no byte-level BPE encoder; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
