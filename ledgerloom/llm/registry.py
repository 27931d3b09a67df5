"""The thin queries ``opN_<name>`` over the whole documents table, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, langid, lm, media, mixing, quality, secrets, sharding, simhash, spelling, toxicity, weighted, whitening
from ledgerloom.llm._common import read_table
from ledgerloom.llm.mixing_sql import MIX
from ledgerloom.llm.quality_sql import QUALITY
from ledgerloom.llm.spelling_sql import VARIANTS

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    hex_digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", hex_digits.alias("fingerprint"), "component_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(documents(spark, sf_dir))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scored(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
    return found.withColumn("passages", F.to_json("passages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(read_table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir), damage=spelling.DAMAGED)


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.compared_with_next(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_sharding": op5_sharding,
    "op6_language_model": op6_language_model,
    "op7_media": op7_media,
    "op8_mixing": op8_mixing,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_spelling": op12_spelling,
    "op13_fingerprint": op13_fingerprint,
}

SQL: dict[str, str] = {"op1_quality": QUALITY, "op8_mixing": MIX, "op12_spelling": VARIANTS}
