"""The contract queries: each applies its operator to the whole intended table and names the asked columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import langid, mixing, prefixes, quality, secrets, simhash, suffixes, toxicity, urls, wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).drop("cosine")


def op2_linkrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_texts(table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.count_tokens(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_linkrank": op2_linkrank,
    "op3_suffixes": op3_suffixes,
    "op4_simhash": op4_simhash,
    "op5_wrapper": op5_wrapper,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_prefixes": op8_prefixes,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
}

SQL: dict[str, str] = {"op3_suffixes": suffixes.SQL, "op6_secrets": secrets.oracle(), "op7_mixing": mixing.SQL}
