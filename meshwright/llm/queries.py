"""Queries of the problems on document text, each over all documents and whole texts."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm import mixing, packing, pii, sizes
from meshwright.tables import table


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return sizes.token_sizes(table(spark, d, "documents"), sizes.tokenizer_path(spark))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), table(spark, d, "pack_specs"), table(spark, d, "mix_targets"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_report(p6_packed(spark, d))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(p6_packed(spark, d))


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    """Shares, targets and debts of the sources in each window."""
    return packing.window_report(p6_packed(spark, d), table(spark, d, "mix_targets"))


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p7_mixed(spark, d), table(spark, d, "mix_targets"))


_drawn: dict[str, str] = {}


def _secret(spark: SparkSession) -> str:
    """Key of the pseudonyms: spark.meshwright.pii.key, else one drawn for this application and known to nobody else."""
    key = spark.conf.get("spark.meshwright.pii.key", None)
    return key or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.pii_items(table(spark, d, "documents"), _secret(spark)).filter(F.col("pii_kind").isin(*pii.PERSONAL)).select("doc_id", "pii_kind", "char_start")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return pii.pii_items(table(spark, d, "documents"), _secret(spark))


def p8_replaced(spark: SparkSession, d: str) -> DataFrame:
    return pii.pii_replaced(table(spark, d, "documents"), _secret(spark))


QUERIES = {f.__name__: f for f in (p6_packed, p6_containers, p6_fill, p6_windows, p7_mixed, p7_shares, p8_found, p8_items, p8_replaced)}
ORACLES: dict[str, str] = {}
