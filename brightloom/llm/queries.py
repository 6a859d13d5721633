"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brightloom.llm import fim, language, licenses, mixing, one_bit, packing, phrases, quality, sharding, simhash, token_shards, toxicity, va_file
from brightloom.llm.shared import table


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies; callers with another place pass their own path to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_ids(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op9_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit.neighbours(table(spark, sf_dir, "embeddings"))


def op10_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.exact_neighbours(table(spark, sf_dir, "embeddings"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run  # its stages read this module

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_toxicity, op3_mixing, op4_packing, op5_language_id, op6_quality, op7_license_scan, op8_token_shards, op9_one_bit_ann, op10_va_file, op11_fill_in_middle,
        op12_jump_sharding, op13_collocations, pipeline,
    )
}
ORACLE_SQL: dict[str, str] = {"op10_va_file": va_file.ORACLE_SQL, "op11_fill_in_middle": fim.ORACLE_SQL, "op12_jump_sharding": sharding.ORACLE_SQL, "op13_collocations": phrases.ORACLE_SQL}
