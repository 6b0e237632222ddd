"""The contract queries of the thirteen training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, dart_minhash, fuzzy_lines, kneser_ney, licenses, merkle, mixing, quality_cascade, sharding, simple8b, suffix_repeats, tiff, turns


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(documents(spark, sf_dir))


def op2_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(documents(spark, sf_dir))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest(documents(spark, sf_dir))


def op5_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.digest(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.digest(documents(spark, sf_dir))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.digest(documents(spark, sf_dir))


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.digest(documents(spark, sf_dir))


def op10_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.digest(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(documents(spark, sf_dir))


def op12_turn_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sampled_splitters, op2_hypergeometric_mix, op3_kneser_ney, op4_tiff_pages, op5_simple8b_tokens, op6_byte_bpe,
        op7_suffix_repeats, op8_fuzzy_lines, op9_dart_minhash, op10_rule_cascade,
        op11_merkle_manifest, op12_turn_automaton, op13_license_rules,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_suffix_repeats": suffix_repeats.ORACLE_SQL,
    "op8_fuzzy_lines": fuzzy_lines.ORACLE_SQL,
    "op9_dart_minhash": dart_minhash.ORACLE_SQL,
    "op10_rule_cascade": quality_cascade.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_turn_automaton": turns.ORACLE_SQL,
}
