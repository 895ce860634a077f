"""Queries over near-duplicate facts and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.llm import neardup, residue, residue_queries
from engrava.operators import delivery
from engrava.plans.delivery import MESSAGE_COLUMNS
from engrava.session import materialise, small
from engrava.sources import read_table


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facts and messages with a session, of at least 80 characters, and the message rows that repeat a delivery."""
    facts = read_table(spark, sf_dir, "facts", F.lit("facts").alias("tbl"), F.col("fact_id").alias("id"), "content")
    messages = read_table(spark, sf_dir, "messages", *MESSAGE_COLUMNS)
    own = messages.where(delivery.session_name(F.col("session_id")).isNotNull()).select(F.lit("messages").alias("tbl"), "id", "content")
    texts = neardup.prepared(facts.unionByName(own), F.col("content"), 80)
    return texts, delivery.repeats(materialise(delivery.delivery_keys(messages), "deliveries")).select(F.lit("messages").alias("tbl"), "id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps, members = neardup.representatives(*_texts(spark, sf_dir))
    links = neardup.pairs(reps, kind="chars", size=5, at_least=0.6, weighted=False)
    found = materialise(neardup.expand(links, members).distinct(), "found")
    # the rows of p1_found take no part; only rows in pairs need to be asked for
    own = found.where("tbl = 'messages'")
    asked = materialise(own.select(F.col("id_a").alias("id")).unionByName(own.select(F.col("id_b").alias("id"))).distinct(), "asked")
    gone = residue.by_table(residue.residue(residue_queries.records(spark, sf_dir, small(asked, 2_000_000)))).where("tbl = 'messages'")
    out = small(gone.select("tbl", F.col("rec_id").cast("bigint").alias("gone")).distinct())
    for side in ("id_a", "id_b"):
        found = found.join(out.withColumnRenamed("gone", side), ["tbl", side], "left_anti")
    return found.select("tbl", "id_a", "id_b")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of facts and of messages at the strict measure (five words, weighted Jaccard 0.8): one row for each record with text, with its representative, group and links.

    All rows take part, redelivered ones and ones without session too; a record's copies are in its group.
    """
    facts = read_table(spark, sf_dir, "facts", F.lit("facts").alias("tbl"), F.col("fact_id").alias("id"), "content")
    messages = read_table(spark, sf_dir, "messages", F.lit("messages").alias("tbl"), "id", "content")
    reps, members = neardup.representatives(neardup.prepared(facts.unionByName(messages), F.col("content"), 1))
    return neardup.placed(neardup.groups(neardup.pairs(reps), reps), members)


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
ORACLE: dict[str, str] = {}
