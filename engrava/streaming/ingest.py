"""Structured Streaming: idempotent ingest into a message table, and running usage counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engrava.operators import delivery, gates, store


def ingest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's new messages to the Parquet folder ``table``: redacted, one row of each message, none stored before.

    Each batch is anti-joined with the stored message keys, so delivery may repeat over any span of time. A batch writes into a
    folder of its own and overwrites only that, so a batch replayed after a failure leaves no second copy.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        clean = batch.withColumn("content", gates.redacted(F.col("content")))
        earlier = stored(spark, table, clean)
        new = delivery.new_messages(clean, earlier.where(F.col("batch") < epoch).drop("batch")) if earlier is not None else delivery.deduplicate(clean)
        new.write.mode("overwrite").parquet(f"{table}/batch={epoch}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, table: str, like: DataFrame) -> DataFrame | None:
    """The stored messages with their ``batch``; null where nothing is stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path) or not files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/batch=*")):
        return None
    return spark.read.schema(like.schema.add("batch", "long")).parquet(table)


def usage_counters(stream: DataFrame, key: str, time: str, table: str, checkpoint: str) -> StreamingQuery:
    """Hits and last use of each key (``key``, ``hits``, ``last_used``), in the Parquet folder ``table``.

    The counters are Spark's state; each batch writes the keys that changed into a folder of its own, which a replay of the
    batch overwrites. ``current_usage`` reads the latest row of each key.
    """

    def write(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/batch={epoch}")

    return store.usage(stream, key, time).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_usage(spark: SparkSession, table: str) -> DataFrame:
    """The latest counters of each key that ``usage_counters`` has written: counters only grow."""
    return spark.read.parquet(table).groupBy("key").agg(F.max("hits").alias("hits"), F.max("last_used").alias("last_used"))
