"""Queries over source mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engrava.llm import mixture
from engrava.sources import read_table


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, sf_dir, "documents", "doc_id", "source", "text"), read_table(spark, sf_dir, "mix_targets")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(*_tables(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, targets = _tables(spark, sf_dir)
    return mixture.shares(mixture.mix(documents, targets), targets)


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares}
ORACLE: dict[str, str] = {}
