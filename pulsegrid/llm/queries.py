"""The queries of this subpackage, each over its whole table, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fingerprint, langid, license, neardup, periods, repeats, shard, url_filter, vector_codes, vector_dups
from ._common import read_table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: (host, path, verdict): the rules of the query.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(read_table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(read_table(spark, sf_dir, "documents"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_report(read_table(spark, sf_dir, "documents"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_report(read_table(spark, sf_dir, "documents"), vocabulary())


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(read_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return chat.chat_report(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(read_table(spark, sf_dir, "embeddings"))


def op12_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_report(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_url_filter": op2_url_filter,
        "op3_shard": op3_shard,
        "op4_langid": op4_langid,
        "op5_neardup": op5_neardup,
        "op6_license_scan": op6_license_scan,
        "op7_bpe": op7_bpe,
        "op8_fingerprint": op8_fingerprint,
        "op9_repeats": op9_repeats,
        "op10_chat_format": op10_chat_format,
        "op11_vector_codes": op11_vector_codes,
        "op12_vector_dups": op12_vector_dups,
        "op13_periodic_runs": op13_periodic_runs,
    }
