"""Readers for the engine's tables."""

from engrava.sources.tables import read_table

__all__ = ["read_table"]
