"""At-least-once delivery: one row per message, however often and in whatever batches it arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrava.functions.text import strip_space

# The names under which each speaker role is written.
ROLE_NAMES = {
    "user": ("user", "human", "client", "customer", "me", "person", "mensch", "nutzer", "benutzer", "用户"),
    "assistant": ("assistant", "ai", "bot", "model", "agent", "gpt", "llm", "assistent", "助手"),
    "system": ("system", "sys", "developer", "系统"),
    "tool": ("tool", "function", "tool_result", "function_call", "werkzeug", "工具"),
}

#: Above this, a time counts as thousandths of a second (the year 5138 in seconds).
MILLIS_FROM = 1e11


def plain_role(role: Column) -> Column:
    """``user``, ``assistant``, ``system`` or ``tool``; null where the name tells none of them."""
    name = F.lower(strip_space(role))
    out = F
    for plain, names in ROLE_NAMES.items():
        out = out.when(name.isin(*names), F.lit(plain))
    return out


def seconds(ts: Column) -> Column:
    """Epoch seconds; null for a missing or non-finite time."""
    finite = ts.isNotNull() & ~F.isnan(ts) & (F.abs(ts) < F.lit(float("inf")))
    return F.when(finite, F.when(F.abs(ts) >= MILLIS_FROM, ts / 1000).otherwise(ts))


def session_name(session_id: Column) -> Column:
    """The session without space around it; null where there is none."""
    return F.nullif(strip_space(session_id), F.lit(""))


def message_hash(session_id: Column, role: Column, content: Column, stored: Column) -> Column:
    """The 64 hex digits of the stored hash in lower case, whatever its prefix; filled in from the row where there are none."""
    digits = F.regexp_extract(F.lower(stored), r"([0-9a-f]{64})", 1)
    text = F.concat(F.coalesce(session_name(session_id), F.lit("")), F.lit("|"), F.coalesce(plain_role(role), role, F.lit("")), F.lit("|"), F.coalesce(content, F.lit("")))
    return F.when(digits != "", digits).otherwise(F.sha2(text, 256))


def delivery_keys(messages: DataFrame) -> DataFrame:
    """``id``, the 16-byte ``key`` of the message and its time ``sec``; rows without a session have none and are left out."""
    sid = session_name(F.col("session_id"))
    key = F.unhex(F.md5(F.concat(sid, F.lit("|"), message_hash(F.col("session_id"), F.col("role"), F.col("content"), F.col("hash")))))
    return messages.where(sid.isNotNull()).select("id", key.alias("key"), seconds(F.col("timestamp")).alias("sec"))


def redelivered(messages: DataFrame) -> DataFrame:
    """The ``id`` of every row that repeats a message: all but the earliest delivery.

    Deliveries of one message share session and hash. Of each message the row with the earliest time stays, a missing time
    counts as last, ties go to the smaller id. The rank is a minimum over (time, id), so Spark combines it before the shuffle
    and one message that makes up a third of all rows is no hot task; only messages that came more than once are joined back.

    Nulls: rows with a null or blank session are never repeats; a null hash is filled in from the row; null content counts as
    empty text. An empty table gives an empty result. Further columns of ``messages`` are not read. ``id`` must be unique.
    """
    return repeats(delivery_keys(messages))


def repeats(keys: DataFrame) -> DataFrame:
    """``redelivered`` by the ``delivery_keys``, which are read twice."""
    first = (
        keys.groupBy("key")
        .agg(F.min(F.struct(F.coalesce("sec", F.lit(float("inf"))).alias("sec"), "id")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("key", F.col("first.id").alias("keep"))
    )
    return keys.join(first, "key").where(F.col("id") != F.col("keep")).select("id")


def deduplicate(messages: DataFrame) -> DataFrame:
    """``messages`` with exactly one row of each message; rows without a session all stay. Columns are unchanged."""
    gone = redelivered(messages).withColumnRenamed("id", "__gone")
    return messages.join(gone, messages["id"] == gone["__gone"], "left_anti")


def new_messages(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``batch`` to append to ``stored``: one of each message, and none whose message is stored already.

    The stored side is reduced to distinct keys, so any size works; rows without a session are always new.
    """
    once = deduplicate(batch)
    known = delivery_keys(stored).select(F.col("key").alias("__key")).distinct()
    keyed = delivery_keys(once).select(F.col("id").alias("__id"), F.col("key").alias("__key"))
    old = keyed.join(known, "__key", "left_semi").select("__id")
    return once.join(old, once["id"] == old["__id"], "left_anti")
