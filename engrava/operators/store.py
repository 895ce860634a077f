"""The stored layers: identity, tombstones, duplicates, capacity, provenance, usage, snapshots and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.functions.text import fingerprint, normalised

#: Shortest prefix by which a tombstone may match a reworded fact.
PREFIX = 40


def vector_state(vector: Column, width: int) -> Column:
    """``null``, ``wrong_width``, ``non_finite``, ``zero`` or ``usable``."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNull(), "null").when(F.size(vector) != width, "wrong_width").when(~finite, "non_finite").when(~F.exists(vector, lambda x: x != 0), "zero").otherwise("usable")


def tombstoned(facts: DataFrame, tombstones: DataFrame, key: str = "fact_id") -> DataFrame:
    """Keys of facts that a tombstone covers: equal fingerprint, or one normalised text begins with the other (40 characters at least).

    Prefixes meet on their first 40 characters, so both passes are equi-joins; no fact is compared with every tombstone.
    """
    texts = facts.where("content IS NOT NULL").select(key, normalised(F.col("content")).alias("text"), fingerprint(F.col("content")).alias("fp"))
    exact = texts.join(tombstones.select("fp").distinct(), "fp", "left_semi").select(key)
    prefix = tombstones.where("content_prefix IS NOT NULL").select(normalised(F.col("content_prefix")).alias("prefix")).where(F.length("prefix") >= PREFIX).distinct()
    head = lambda c: F.substring(c, 1, PREFIX)
    near = texts.where(F.length("text") >= PREFIX).withColumn("head", head(F.col("text"))).join(prefix.withColumn("head", head(F.col("prefix"))), "head")
    near = near.where(F.startswith("text", "prefix") | F.startswith("prefix", "text")).select(key)
    return exact.unionByName(near).distinct()


def newest_by_content(facts: DataFrame) -> DataFrame:
    """Of facts with equal normalised content the newest (time text, then larger id): ``fact_id``, ``copies``. Null content stays out."""
    text = facts.where("content IS NOT NULL").select(normalised(F.col("content")).alias("text"), F.struct(F.coalesce("timestamp", F.lit("")).alias("t"), "fact_id").alias("x"))
    return text.groupBy("text").agg(F.max("x").alias("x"), F.count("*").alias("copies")).select(F.col("x.fact_id").alias("fact_id"), "copies")


def over_capacity(facts: DataFrame, cap: int) -> DataFrame:
    """Facts to evict so that every agent keeps its ``cap`` newest (time text, then id): the kept are found by a limited rank, the rest leave."""
    order = Window.partitionBy("agent").orderBy(F.desc(F.coalesce("timestamp", F.lit(""))), F.desc("fact_id"))
    owned = facts.select("fact_id", F.coalesce("agent", F.lit("")).alias("agent"), "timestamp")
    kept = owned.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select("fact_id")
    return owned.join(kept, "fact_id", "left_anti").select("fact_id", "agent")


def usage(events: DataFrame, key: str, time: str) -> DataFrame:
    """Hit counters: ``key``, ``hits`` and ``last_used``; a plain aggregation, also over a stream."""
    return events.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("hits"), F.max(time).alias("last_used"))


def latest_exports(candidates: DataFrame) -> DataFrame:
    """Of each candidate id the latest export (update time, then import time, then summary)."""
    columns = [c for c in candidates.columns if c != "id"]
    newest = F.max_by(F.struct(*columns), F.struct(F.coalesce("updated_at", F.lit("")), F.coalesce("imported_at", F.lit("")), F.coalesce("summary", F.lit(""))))
    return candidates.where("id IS NOT NULL").groupBy("id").agg(newest.alias("x"), F.count("*").alias("n_exports")).select("id", "n_exports", "x.*")


def index_difference(stored: DataFrame, index: DataFrame, slack: float = 0.5) -> DataFrame:
    """Three-way difference of two (path, mtime) sets: ``missing`` in the index, ``stale`` there, ``orphaned``, or ``current``."""
    both = stored.select("path", F.col("mtime").alias("m")).join(index.select("path", F.col("mtime").alias("i")), "path", "full_outer")
    state = F.when(F.col("i").isNull(), "missing").when(F.col("m").isNull(), "orphaned").when(F.abs(F.col("m") - F.col("i")) > slack, "stale").otherwise("current")
    return both.select("path", state.alias("state"))
