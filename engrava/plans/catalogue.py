"""Every query of the core, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engrava.plans import delivery, notes, recall, retrieval, store, store_sql, upkeep

QUERY_MODULES = (delivery, retrieval, store, recall, notes, upkeep)
SQL_MODULES = (delivery, retrieval, store_sql, recall, notes, upkeep)


def queries() -> dict:
    return {name: f for m in QUERY_MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in SQL_MODULES for name, sql in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.q01_vector_topk(spark, sf_dir)
