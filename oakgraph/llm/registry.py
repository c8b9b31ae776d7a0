"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import small_batches, table
from . import ann, bpe, chunks, language, mixing, near_dups, oracles, pii, quality, token_files, warc

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.build_index(table(spark, sf_dir, "embeddings"))
    return ann.search(index, index.rows.where(F.col("id") % 100 == 0), 10)


def op2_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.cross_checked(table(spark, sf_dir, "documents"))


def op3_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op6_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op9_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.summary(table(spark, sf_dir, "documents"), short_copies=True)


def op10_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def _tuned(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_one_bit_ann": op1_one_bit_ann,
        "op2_crf_language": op2_crf_language,
        "op3_disclosure_pii": op3_disclosure_pii,
        "op4_token_orc": op4_token_orc,
        "op5_source_mixing": op5_source_mixing,
        "op6_bayesian_minhash": op6_bayesian_minhash,
        "op7_warc_index": op7_warc_index,
        "op8_quality_rules": op8_quality_rules,
        "op9_gear_chunks": op9_gear_chunks,
        "op10_speculative_bpe": op10_speculative_bpe,
    }
    return {name: _tuned(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
