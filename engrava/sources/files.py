"""File sources: Markdown vaults, JSON lines with broken rows, and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from engrava.functions import notes


def read_vault(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of a Markdown vault: ``path``, ``section``, ``mtime``, ``title``, ``status``, ``tags``, ``links``, ``body``. Index pages and dot folders stay out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(folder)
    files = files.where(~F.col("path").rlike(r"/\.[^/]+/|/index\.md$"))
    text = F.decode("content", "UTF-8")
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("section"), F.unix_timestamp("modificationTime").cast("double").alias("mtime"), text.alias("text")).select(
        "path", "section", "mtime", notes.title(F.col("text")).alias("title"), notes.field(F.col("text"), "status").alias("status"), notes.tags(F.col("text")).alias("tags"), notes.links(F.col("text")).alias("links"), notes.body(F.col("text")).alias("body")
    )


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines file and, apart, its broken lines as ``line``; nothing is lost."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    wide = StructType([*schema.fields]).add("_broken", StringType())
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("x"))
    good = parsed.where(F.col("x._broken").isNull()).select(*[F.col(f"x.{f.name}").alias(f.name) for f in schema.fields])
    return good, parsed.where(F.col("x._broken").isNotNull()).select(F.col("value").alias("line"))


def write_snapshot(facts: DataFrame, path: str, most: int = 2000) -> None:
    """The newest ``most`` facts as JSON lines."""
    facts.orderBy(F.desc_nulls_last("timestamp"), "fact_id").limit(most).coalesce(1).write.mode("overwrite").json(path)


def read_entries(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a JSON array or of JSON lines, whichever the file is."""
    head = spark.read.text(path, wholetext=False).where(F.length(F.trim("value")) > 0).limit(1).collect()
    whole = bool(head) and head[0].value.lstrip("\ufeff \t").startswith("[")
    return spark.read.schema(schema).option("multiLine", whole).json(path)
