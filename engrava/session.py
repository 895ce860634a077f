"""Session helpers: lineage cuts in shared storage, their removal, and checked sizes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is absent, a session in one process gets a folder of its own; with executors elsewhere that would lose
    data, so it raises ``ValueError``.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    kept = "file://" + tempfile.mkdtemp(prefix="spark-engrava-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", kept)
    return kept


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the plan is cut, and lost executors cost no recomputation. See ``scratch``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/engrava-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    # nothing reads this write's shuffles again: Spark may delete their files as soon as it is done
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``materialise`` writes within, on leaving: plans made within must have been run by then."""
    first = len(_written)
    try:
        yield
    finally:
        for name in _written[first:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _written[first:]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def is_small(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is: the same equi-join, by a shuffle."""
    return F.broadcast(df) if is_small(df, most) else df
