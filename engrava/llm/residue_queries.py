"""Queries over template residue and error pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.llm import residue
from engrava.sources import read_table


def records(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """Messages and candidates as one corpus; with ``asked`` (distinct ``id``) only those messages are asked for, see ``residue``."""
    messages = read_table(spark, sf_dir, "messages", "id", "session_id", "metadata", "content")
    candidates = residue.candidate_records(read_table(spark, sf_dir, "candidates", "id", "source_path", "summary", "metadata", "content"))
    if asked is not None:
        messages = messages.join(asked.select("id", F.lit(True).alias("asked")), "id", "left")
        candidates = candidates.withColumn("asked", F.lit(False))
    return residue.together({"messages": residue.message_records(messages), "candidates": candidates})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.by_table(residue.residue(records(spark, sf_dir))).select("tbl", "rec_id").distinct()


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct records of each table are residue, by kind."""
    return residue.by_table(residue.residue(records(spark, sf_dir))).distinct().groupBy("tbl", "kind").agg(F.count("*").alias("n_records"))


def p1_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct records of each table are residue, by what decided on them."""
    return residue.by_table(residue.evidence(records(spark, sf_dir))).distinct().groupBy("tbl", "decided_by").agg(F.count("*").alias("n_records"))


QUERIES = {"p1_found": p1_found, "p1_kinds": p1_kinds, "p1_evidence": p1_evidence}
ORACLE: dict[str, str] = {}
