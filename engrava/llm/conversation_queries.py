"""Queries over rebuilt conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.functions.text import INVISIBLE
from engrava.llm import conversations
from engrava.plans.delivery import _KEYED, MESSAGE_COLUMNS
from engrava.sources import read_table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = read_table(spark, sf_dir, "messages", *MESSAGE_COLUMNS)
    return conversations.judged_sessions(messages).where("dropped").select("session_id")


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by the reason for which they are dropped."""
    messages = read_table(spark, sf_dir, "messages", *MESSAGE_COLUMNS)
    return conversations.judged_sessions(messages).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n_sessions"))


def p5_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn that takes part with its place in its session."""
    messages = read_table(spark, sf_dir, "messages", *MESSAGE_COLUMNS)
    return conversations.rebuild(messages).select("id", "root", "position", "parent")


def p5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the conversations that stay, root to leaf, with the fingerprint of their texts."""
    turns = conversations.conversations(read_table(spark, sf_dir, "messages", *MESSAGE_COLUMNS))
    return turns.select("session_id", "position", "role", "id", F.md5("content").alias("content_md5"))


QUERIES = {"p5_conversations": p5_conversations, "p5_found": p5_found, "p5_reasons": p5_reasons, "p5_positions": p5_positions}

_TURNS = (
    _KEYED
    + rf""", spoken AS (
  SELECT sid, id, prole, coalesce(sec, 'infinity'::DOUBLE) AS t FROM ranked
  WHERE rn = 1 AND sid IS NOT NULL AND prole IN ('user', 'assistant') AND content IS NOT NULL AND regexp_matches(content, '[^{INVISIBLE}]')
), ordered AS (
  SELECT sid, id, prole, lead(prole) OVER w AS next_role, lag(id) OVER w AS parent, row_number() OVER w AS pos, first_value(id) OVER w AS root
  FROM spoken WINDOW w AS (PARTITION BY sid ORDER BY t, id)
), told AS (
  SELECT s.sid, count(*) FILTER (WHERE prole = 'user') AS n_user, count(*) FILTER (WHERE prole = 'assistant') AS n_assistant,
         bool_or(pos = 1 AND prole <> 'user') AS late, bool_or(prole = 'user' AND next_role IS DISTINCT FROM 'assistant') AS open
  FROM (SELECT DISTINCT sid FROM ranked WHERE rn = 1 AND sid IS NOT NULL) s LEFT JOIN ordered o ON o.sid = s.sid GROUP BY s.sid
), reasoned AS (
  SELECT sid AS session_id, CASE WHEN n_user = 0 THEN 'no_user' WHEN n_assistant = 0 THEN 'no_assistant' WHEN late THEN 'late_user' WHEN open THEN 'unanswered' END AS reason FROM told
)
"""
)

ORACLE = {
    "p5_found": _TURNS + "SELECT session_id FROM reasoned WHERE reason IS NOT NULL",
    "p5_reasons": _TURNS + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n_sessions FROM reasoned GROUP BY 1",
    "p5_conversations": _TURNS + "SELECT sid AS session_id, pos - 1 AS position, prole AS role, o.id, md5(m.content) AS content_md5 FROM ordered o JOIN messages m ON m.id = o.id WHERE sid IN (SELECT session_id FROM reasoned WHERE reason IS NULL)",
    "p5_positions": _TURNS + "SELECT id, root, pos - 1 AS position, parent FROM ordered",
}
