"""The registered queries opN_<name> of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio_fingerprint, language_id, license_scan, mixing, near_dedup, packing, pii, quality_rules, token_counts, url_filter
from .common import documents


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), 1024)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=2, percent=80)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"), 4096)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The rules of the query, as lines of verdict, host and path.
URL_RULES = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.parse_rules(URL_RULES))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(documents(spark, sf_dir)).select("doc_id", "source", F.col("_replica").cast("long").alias("replica"), F.col("_order").alias("shuffle_key"))


def op10_audio_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return audio_fingerprint.match(media, "vec_id", "embedding", audio_fingerprint.embedded, 50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_near_dedup": op4_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_audio_fingerprint": op10_audio_fingerprint,
}

ORACLE_SQL: dict[str, str] = {
    "op7_quality_rules": quality_rules.oracle(),
    "op9_mixing": mixing.ORACLE,
}
