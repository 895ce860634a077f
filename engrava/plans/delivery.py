"""Queries over redelivered messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.operators import delivery
from engrava.sources import read_table

MESSAGE_COLUMNS = ("id", "session_id", "role", "content", "timestamp", "hash")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.redelivered(read_table(spark, sf_dir, "messages", *MESSAGE_COLUMNS))


def p3_kept_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that remain, by role: the whole table is deduplicated, then profiled."""
    kept = delivery.deduplicate(read_table(spark, sf_dir, "messages", *MESSAGE_COLUMNS))
    return kept.groupBy(F.coalesce(delivery.plain_role(F.col("role")), F.lit("unknown")).alias("plain_role")).agg(
        F.count("*").alias("n_rows"), F.countDistinct(delivery.session_name(F.col("session_id"))).alias("n_sessions")
    )


def p3_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newer half of the feed (by id) as batches after the older half: ids of the rows to append."""
    messages = read_table(spark, sf_dir, "messages", *MESSAGE_COLUMNS)
    half = messages.agg(F.floor((F.min("id") + F.max("id")) / 2).alias("half"))
    marked = messages.crossJoin(F.broadcast(half))
    return delivery.new_messages(marked.where("id > half").drop("half"), marked.where("id <= half").drop("half")).select("id")


QUERIES = {"p3_found": p3_found, "p3_kept_by_role": p3_kept_by_role, "p3_append": p3_append}

_INVISIBLE = r"\s\p{Z}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{00AD}\x{180E}"

_KEYED = rf"""
WITH named AS (
  SELECT *, nullif(regexp_replace(session_id, '^[{_INVISIBLE}]+|[{_INVISIBLE}]+$', '', 'g'), '') AS sid,
         lower(regexp_replace(role, '^[{_INVISIBLE}]+|[{_INVISIBLE}]+$', '', 'g')) AS rname
  FROM messages
), roled AS (
  SELECT *, CASE WHEN rname IN ({", ".join(repr(x) for x in delivery.ROLE_NAMES["user"])}) THEN 'user'
                 WHEN rname IN ({", ".join(repr(x) for x in delivery.ROLE_NAMES["assistant"])}) THEN 'assistant'
                 WHEN rname IN ({", ".join(repr(x) for x in delivery.ROLE_NAMES["system"])}) THEN 'system'
                 WHEN rname IN ({", ".join(repr(x) for x in delivery.ROLE_NAMES["tool"])}) THEN 'tool' END AS prole,
         CASE WHEN "timestamp" IS NOT NULL AND isfinite("timestamp")
              THEN CASE WHEN abs("timestamp") >= 1e11 THEN "timestamp" / 1000 ELSE "timestamp" END END AS sec
  FROM named
), keyed AS (
  SELECT *, coalesce(nullif(regexp_extract(lower(hash), '([0-9a-f]{{64}})', 1), ''),
                     sha256(coalesce(sid, '') || '|' || coalesce(prole, role, '') || '|' || coalesce(content, ''))) AS h
  FROM roled
), ranked AS (
  SELECT *, CASE WHEN sid IS NULL THEN 1
                 ELSE row_number() OVER (PARTITION BY sid, h ORDER BY coalesce(sec, 'infinity'::DOUBLE), id) END AS rn
  FROM keyed
)
"""

ORACLE = {
    "p3_found": _KEYED + "SELECT id FROM ranked WHERE rn > 1",
    "p3_kept_by_role": _KEYED + "SELECT coalesce(prole, 'unknown') AS plain_role, count(*) AS n_rows, count(DISTINCT sid) AS n_sessions FROM ranked WHERE rn = 1 GROUP BY 1",
    "p3_append": _KEYED
    + """, half AS (SELECT floor((min(id) + max(id)) / 2) AS half FROM messages),
    late AS (SELECT *, CASE WHEN sid IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY sid, h ORDER BY coalesce(sec, 'infinity'::DOUBLE), id) END AS ln
             FROM keyed WHERE id > (SELECT half FROM half))
    SELECT id FROM late l WHERE ln = 1 AND (sid IS NULL OR NOT EXISTS (SELECT 1 FROM keyed k, half WHERE k.id <= half AND k.sid = l.sid AND k.h = l.h))""",
}
