"""The queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, decontaminate, exact_dedup, near_dedup, pii, quality, secrets, sharding, substring_dedup, toxicity
from graphloom.llm.common import documents_of, table_of


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored_with_folds(documents_of(spark, sf_dir), table_of(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign_survivors(documents_of(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents_of(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents_of(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only documents that overlap with the benchmark have rows."""
    return decontaminate.overlapping(documents_of(spark, sf_dir), table_of(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(documents_of(spark, sf_dir))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents_of(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    return quality.grade_documents(docs, quality.train(docs, table_of(spark, sf_dir, "labels")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents_of(spark, sf_dir))


#: Percent of the union that two sets must share in op10.
OP10_SIMILARITY = 85


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_components(documents_of(spark, sf_dir), OP10_SIMILARITY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_byte_bpe, op4_secrets, op5_decontamination, op6_substring_dedup, op7_personal_data, op8_quality, op9_sharding, op10_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op4_secrets": secrets.ORACLE_SQL, "op6_substring_dedup": substring_dedup.ORACLE_SQL, "op10_near_dedup": near_dedup.ORACLE_SQL}
