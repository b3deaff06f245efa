"""The queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aerolith.llm import encode, mixing, quality, truncation
from aerolith.sources.tables import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(table(spark, d, "messages"))


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "messages"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.counted(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    counts, targets = mixing.counted(table(spark, d, "documents")), table(spark, d, "mix_targets")
    return mixing.shares(counts, mixing.mix(counts, targets), targets)


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.judged(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).where("kind <> 'prose'").select("doc_id", "kind")


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics, "p7_found": p7_found, "p7_rates": p7_rates, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
