"""Queries over reading levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engrava.llm import reading
from engrava.sources import read_table


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.levels(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "reading_labels", "doc_id", "level"))


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.profile(read_table(spark, sf_dir, "documents", "doc_id", "source", "lang"), p9_levels(spark, sf_dir))


QUERIES = {"p9_levels": p9_levels, "p9_profile": p9_profile}
ORACLE: dict[str, str] = {}
