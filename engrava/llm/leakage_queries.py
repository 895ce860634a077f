"""Queries over evaluation passages in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.llm import leakage
from engrava.sources import read_table


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "bench", "item_id", F.col("answer").alias("text"))
    return leakage.leaks(read_table(spark, sf_dir, "documents", "doc_id", "text"), items)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it and the largest share held."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("share").alias("largest_share"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
ORACLE: dict[str, str] = {}
