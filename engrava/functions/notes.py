"""Markdown notes: frontmatter, titles and links, as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frontmatter(text: Column) -> Column:
    """The block between the leading ``---`` lines; empty where there is none."""
    return F.regexp_extract(text, r"^---\n([\s\S]*?)\n---(?:\n|$)", 1)


def field(text: Column, name: str) -> Column:
    """A scalar of the frontmatter; null where absent or empty."""
    return F.nullif(F.trim(F.regexp_extract(F.concat(F.lit("\n"), frontmatter(text), F.lit("\n")), rf"\n{name}:[ ]*([^\n]*)\n", 1)), F.lit(""))


def tags(text: Column) -> Column:
    """The flow list of ``tags``, trimmed, in order and without repeats."""
    return flow_list(text, "tags")


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"^---\n[\s\S]*?\n---(?:\n|$)", "")


def title(text: Column) -> Column:
    """The frontmatter's title, else the first heading, else the first 40 characters of the body."""
    heading = F.nullif(F.regexp_extract(F.concat(F.lit("\n"), body(text), F.lit("\n")), r"\n# +([^\n]+)\n", 1), F.lit(""))
    return F.coalesce(field(text, "title"), heading, F.substring(F.trim(body(text)), 1, 40))


def links(text: Column) -> Column:
    """Targets of ``[[target|alias]]`` links: the last path segment, in order and without repeats."""
    raw = F.regexp_extract_all(text, F.lit(r"\[\[([^\]\[|#]+)(?:#[^\]\[|]*)?(?:\|[^\]\[]*)?\]\]"), 1)
    return F.array_distinct(F.transform(raw, lambda t: F.trim(F.element_at(F.split(t, "/"), -1))))


def flow_list(text: Column, name: str) -> Column:
    """A flow list of the frontmatter, trimmed, in order and without repeats; empty where there is none."""
    inner = F.regexp_extract(F.coalesce(field(text, name), F.lit("")), r"^\[(.*)\]$", 1)
    return F.array_distinct(F.filter(F.transform(F.split(inner, ","), lambda t: F.trim(t)), lambda t: t != ""))
