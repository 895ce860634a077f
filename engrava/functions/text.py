"""Text rules shared by all operators, as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of any script and characters that print nothing.
INVISIBLE = r"\s\p{Z}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{00AD}\x{180E}"

CJK = r"\x{4E00}-\x{9FFF}"


def strip_space(c: Column) -> Column:
    """Trim white space and invisible characters of any kind from both ends."""
    return F.regexp_replace(c, f"^[{INVISIBLE}]+|[{INVISIBLE}]+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty, and text of only white space and invisible characters."""
    return c.isNull() | ~c.rlike(f"[^{INVISIBLE}]")


def normalised(c: Column) -> Column:
    """Lower case, runs of white space (of any script) to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def fingerprint(c: Column) -> Column:
    """SHA-256 hex of the normalised text."""
    return F.sha2(normalised(c), 256)


def weighted_length(c: Column) -> Column:
    """Characters, with three for each CJK ideograph."""
    return F.length(c) + 2 * F.length(F.regexp_replace(c, f"[^{CJK}]", ""))


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters; none for texts under two characters."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(F.length(c) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def occurrences(c: Column, part: Column) -> Column:
    """How often ``part`` occurs in ``c`` without overlap; 0 for an empty part."""
    return F.when(F.length(part) > 0, (F.length(c) - F.length(F.replace(c, part, F.lit("")))) / F.length(part)).otherwise(F.lit(0)).cast("bigint")


def sentences(c: Column) -> Column:
    """Sentences without their final marks (a question keeps its own): cut after ideographic marks, after ``.!?`` before space and a capital, digit or ideograph, and at line ends. Numbers, addresses and versions stay whole; null gives null."""
    marked = F.regexp_replace(F.regexp_replace(c, r"([。！？；])", "$1\n"), r"([.!?])(\s+[A-Z0-9\x{4E00}-\x{9FFF}])", "$1\n$2")
    cut = F.split(marked, r"\n+")
    return F.filter(F.transform(cut, lambda s: strip_space(F.regexp_replace(strip_space(s), r"[.!。！？；]+\s*$", ""))), lambda s: s != "")


# Elements of a page that hold no text of its own, and elements that end a line.
NOISE = "script style nav header footer aside noscript form".split()
BLOCKS = "p|div|li|h[1-6]|tr|br|section|article|blockquote|pre"
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(c: Column) -> Column:
    """The text of a page: noise elements dropped, block elements to line ends, tags to spaces, common entities resolved, space collapsed."""
    for name in NOISE:
        c = F.regexp_replace(c, rf"(?is)<{name}[^>]*>.*?</{name}>", " ")
    c = F.regexp_replace(F.regexp_replace(c, rf"(?i)</?(?:{BLOCKS})[^>]*>", "\n"), r"<[^>]+>", " ")
    for entity, plain in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t\r]+", " "), r"\n\s*\n+", "\n\n"), r"^\s+|\s+$", "")


def content_text(c: Column) -> Column:
    """The text of a message that may be a JSON list of parts: the texts of its text parts, one a line; other content as it is, null as empty."""
    parts = F.from_json(c, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(parts, lambda p: p.text.isNotNull() & (F.coalesce(p.type, F.lit("text")) == "text")), lambda p: p.text)
    return F.when(c.isNull(), "").when(c.rlike(r"^\s*\[\s*\{") & parts.isNotNull(), F.array_join(texts, "\n")).otherwise(c)


def undecorated(c: Column) -> Column:
    """Without list marks, quote marks, numbering and symbols before the text, peeled up to four times."""
    for _ in range(4):
        c = F.regexp_replace(c, r"^\s*(?:[-*+•·>#]+|\d{1,3}[.)、]|[\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}]+|\[[ xX]\])\s*", "")
    return F.trim(c)


def slug(c: Column, longest: int = 120) -> Column:
    """A file name: characters that paths do not allow to hyphens, no hyphens or dots at the ends, ``untitled`` where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), r"[\\\\/:*?\"<>|\s]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(F.length(plain) > 0, F.substring(plain, 1, longest)).otherwise("untitled")


def truncated(c: Column, tokens: int, mark: str = "…", per_token: int = 3) -> Column:
    """The text cut to ``tokens`` at ``per_token`` characters each, with a mark where something was cut."""
    most = tokens * per_token
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def idle_days(now: float, last_used: Column, changed: Column) -> Column:
    """Days since the last use, else since the last change, in epoch seconds; never below 0, null where neither is known."""
    since = F.coalesce(last_used, changed)
    return F.when(since.isNotNull(), F.greatest(F.lit(0.0), (F.lit(now) - since) / 86400))
