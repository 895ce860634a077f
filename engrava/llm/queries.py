"""Queries and SQL of the operators on language-model data."""

from __future__ import annotations

from engrava.llm import conversation_queries, leakage_queries, mixture_queries, neardup_queries, neighbour_queries, privacy_queries, reading_queries, residue_queries

MODULES = (residue_queries, neighbour_queries, neardup_queries, conversation_queries, privacy_queries, leakage_queries, mixture_queries, reading_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
