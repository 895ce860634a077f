"""Admission: the first reason for which a sentence is no fact, as one ordered column expression."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrava.functions.text import is_blank, weighted_length
from engrava.operators import delivery

# The gate's rules in order, each a name and a pattern on the trimmed text.
RULES = (
    ("question", r"[?？]\s*$"),
    ("media", r"(?i)!\[[^\]]*\]\(|data:image/|\.(?:png|jpe?g|gif|mp3|mp4)\b"),
    ("credential", r"(?i)\b(?:api[_-]?key|token|secret|password)\s*[:=]\s*\S{6,}"),
    ("greeting", r"(?i)^(?:hi|hello|hey|thanks|thank you|ok|okay|你好|谢谢|hallo|danke)[\s,.!，。！]*$"),
    ("command", r"^(?:/|\$ |> |sudo |git |pip |npm )"),
    ("code", r"```|^(?:import |from \w+ import|def |class |SELECT )"),
    ("markdown", r"^(?:#{1,6} |\| |- \[[ x]\] |---)"),
    ("json", r"^\s*[\[{][\s\S]*[\]}]\s*$"),
    ("narration", r"(?i)^(?:let me|i will|i'll|i am going to|now i)\b"),
    ("lead_in", r"[:：]\s*$"),
)


def rejection(content: Column, shortest: int = 6, longest: int = 500) -> Column:
    """The name of the first rule that rejects the text, null where it passes; null and blank text is ``empty``."""
    text = F.trim(content)
    reason = F.when(is_blank(content), "empty").when(weighted_length(text) < shortest, "short").when(F.length(text) > longest, "long")
    for name, pattern in RULES:
        reason = reason.when(text.rlike(pattern), name)
    return reason


# Forms of structural evidence: address, path, identifier, digit, Latin word.
EVIDENCE = (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+", r"\b[a-z]+_[a-z0-9_]+\b|\b[a-z]+[A-Z]\w+\b", r"\d", r"[A-Za-z]{3,}")


def evidence(content: Column) -> Column:
    """How many of the forms of ``EVIDENCE`` a text has."""
    return sum((F.coalesce(content.rlike(k), F.lit(False)).cast("int") for k in EVIDENCE), F.lit(0))


# Secret-like patterns by name.
SECRETS = {
    "provider_key": r"\bsk-[A-Za-z0-9_-]{15,}",
    "platform_token": r"\bgh[pousr]_[A-Za-z0-9_]{15,}",
    "key_value": r"(?i)\b(?:api[_-]?key|app[_-]?secret|token|secret|password|passwd|pwd)\s*[:=]\s*\S{6,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "bearer": r"(?i)bearer [a-z0-9._-]{16,}",
    "ssh_record": r"(?i)SSH-[^,\s]{1,24},[^,\s]{1,32},[^,\s]{6,64},ssh://",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "hex_block": r"\b[0-9a-f]{32,64}\b",
}


def secret_names(content: Column) -> Column:
    """The names of the secret-like patterns in a text; null for null."""
    return F.array_compact(F.array(*[F.when(content.rlike(p), F.lit(n)) for n, p in SECRETS.items()]))


def redacted(content: Column) -> Column:
    """Inline images, private keys, tokens, credential records and key=value secrets (the key stays) replaced."""
    text = F.regexp_replace(content, r"data:image/[a-z+]+;base64,[A-Za-z0-9+/=]+", "[IMAGE]")
    text = F.regexp_replace(text, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED]")
    for name in ("provider_key", "platform_token", "access_key"):
        text = F.regexp_replace(text, SECRETS[name], "[REDACTED]")
    text = F.regexp_replace(text, r"(?i)(SSH-[^,\s]{1,24},[^,\s]{1,32},)[^,\s]{6,64}(,ssh://)", "$1[REDACTED]$2")
    text = F.regexp_replace(text, r"(?i)\bbearer [a-z0-9._-]{16,}", "bearer [REDACTED]")
    return F.regexp_replace(text, r"(?i)\b(api[_-]?key|app[_-]?secret|token|secret|password|passwd|pwd)(\s*[:=]\s*)\S{6,}", "$1$2[REDACTED]")


def redaction_backfill(messages: DataFrame) -> DataFrame:
    """The rows of ``messages`` whose stored text still holds a secret, with the redacted text and the hash that belongs to it; all other columns as they are."""
    text = redacted(F.col("content"))
    changed = messages.withColumn("__clean", text).where(F.col("__clean") != F.col("content"))
    return changed.withColumns({"content": F.col("__clean"), "hash": delivery.message_hash(F.col("session_id"), F.col("role"), F.col("__clean"), F.lit(None).cast("string"))}).select(messages.columns)


def desensitised(texts: DataFrame, names: DataFrame) -> DataFrame:
    """The texts (``id``, ``text``) that hold a name of the list (``entity``, ``placeholder``), with every name replaced, the longest first: ``id``, ``text``.

    The list is a stated set and goes to the tasks; each text is searched once for all names. Null and empty texts and names take no part.
    """
    listed = [(r.entity, r.placeholder) for r in names.where("length(entity) > 0 AND placeholder IS NOT NULL").select("entity", "placeholder").distinct().collect()]
    shared = texts.sparkSession.sparkContext.broadcast(sorted(listed, key=lambda x: (-len(x[0]), x)))

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for nth, (name, _) in enumerate(shared.value):
            found.add_word(name, nth)
        if len(found):
            found.make_automaton()
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                here = sorted({nth for _, nth in found.iter(text)}) if len(found) else ()
                for nth in here:
                    text = text.replace(*shared.value[nth])
                if here:
                    rows.append((key, text))
            yield pd.DataFrame(rows, columns=["id", "text"])

    return texts.where("length(text) > 0").select("id", "text").mapInPandas(replace, "id bigint, text string")
