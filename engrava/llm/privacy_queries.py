"""Queries over personal information."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.llm import privacy
from engrava.sources import read_table


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = read_table(spark, sf_dir, "messages", F.concat(F.lit("messages|"), F.col("id").cast("string")).alias("rec_id"), "content")
    candidates = read_table(spark, sf_dir, "candidates", F.concat(F.lit("candidates|"), F.col("id")).alias("rec_id"), "content")
    found = privacy.sanitise(messages.unionByName(candidates), read_table(spark, sf_dir, "entity_map", "entity", "placeholder"))
    return found.withColumn("tbl", F.substring_index("rec_id", "|", 1)).withColumn("rec_id", F.expr("substring(rec_id, length(tbl) + 2)"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).select("tbl", "rec_id", F.explode("kinds").alias("kind")).distinct()


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with placeholders, of the records that held personal information."""
    return _clean(spark, sf_dir).select("tbl", "rec_id", "clean").distinct()


QUERIES = {"p6_found": p6_found, "p6_texts": p6_texts}
ORACLE: dict[str, str] = {}
