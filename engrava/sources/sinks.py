"""Writes to stored tables: append by a declared schema, upsert, delete by predicate, and rewrites that keep the old rows on failure."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def append(rows: DataFrame, path: str, schema: StructType) -> None:
    """Append ``rows`` to the Parquet folder ``path`` with exactly the declared columns: others are dropped, missing ones are null."""
    have = set(rows.columns)
    rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("append").parquet(path)


def upserted(stored: DataFrame, updates: DataFrame, *keys: str) -> DataFrame:
    """``stored`` with the rows of ``updates`` in place of those with their keys; new keys are added. ``updates`` has each key once; columns are those of ``stored``."""
    return stored.join(updates.select(*keys).distinct(), list(keys), "left_anti").select(stored.columns).unionByName(updates.select(stored.columns))


def without(stored: DataFrame, predicate: Column) -> DataFrame:
    """``stored`` without the rows for which ``predicate`` is true; rows for which it is null stay."""
    return stored.where(~F.coalesce(predicate, F.lit(False)))


def rewrite(rows: DataFrame, path: str) -> None:
    """Replace the Parquet folder ``path`` by ``rows``, which may read it: written beside it first, so a failed write leaves the old rows."""
    spark = rows.sparkSession
    new, old = f"{path}-new-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    rows.write.parquet(new)
    hadoop = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(hadoop(path)):
        files.rename(hadoop(path), hadoop(old))
    files.rename(hadoop(new), hadoop(path))
    files.delete(hadoop(old), True)
    spark.catalog.refreshByPath(path)
