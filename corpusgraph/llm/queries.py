"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, licences, longdup, media, mixing, neardup, negatives, phrases, pieces, private, quality, sharding, worddup
from .common import table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pseudonym_key(spark: SparkSession) -> str:
    """The secret that the session names; a public one, for tests only, where it names none."""
    return spark.conf.get("spark.corpusgraph.pseudonymKey", "public-test-key")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longdup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.clean_documents(table(spark, sf_dir, "documents"), pseudonym_key(spark))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_pieces(table(spark, sf_dir, "documents"), piece_model())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.label_documents(table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences_of(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.relabel(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worddup.remove_repeated_windows(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mixing, op2_language_id, op3_quality_rules, op4_suffix_dedup, op5_private_data, op6_sentencepiece, op7_sharding, op8_near_duplicates, op9_licences, op10_media, op11_hard_negatives, op12_collocations, op13_substring_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_licences": licences.oracle(), "op11_hard_negatives": negatives.oracle(), "op12_collocations": phrases.oracle(), "op13_substring_dedup": worddup.oracle()}
