"""Queries over most similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.llm import neighbours
from engrava.operators import retrieval
from engrava.sources import read_table


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "facts", F.col("fact_id").alias("id"), "vector"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _nearest(spark, sf_dir)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p2_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many facts have how many similar others within the reported five."""
    return _nearest(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n_similar")).groupBy("n_similar").agg(F.count("*").alias("n_facts"))


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against brute force for every row whose id is divisible by 20: pairs that exact search gives, and how many of them the index has."""
    facts = read_table(spark, sf_dir, "facts", F.col("fact_id").alias("id"), "vector").where(neighbours.usable(F.col("vector"), 64))
    asked = facts.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    exact = retrieval.vector_topk(asked, facts, 5).where(F.round(2 * F.col("score") - 1, 6) >= 0.86).select("qid", "id")
    has = _nearest(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("other").alias("id"), F.lit(1).alias("has"))
    return exact.join(has, ["qid", "id"], "left").agg(F.count("*").alias("n_exact"), F.count("has").alias("n_has"), F.round(F.avg(F.coalesce("has", F.lit(0))), 4).alias("recall"))


QUERIES = {"p2_found": p2_found, "p2_degrees": p2_degrees, "p2_recall": p2_recall}
_USABLE = "len(vector) = 64 AND list_bool_and(list_transform(vector, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(vector, lambda x: x <> 0))"
ORACLE = {
    "p2_found": f"""WITH u AS (SELECT fact_id AS id, vector::DOUBLE[] AS v FROM facts WHERE {_USABLE}),
      c AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM u a JOIN u b ON a.id <> b.id),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS place FROM c WHERE cosine >= 0.86)
      SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM r WHERE place <= 5""",
    "p2_degrees": f"""WITH u AS (SELECT fact_id AS id, vector::DOUBLE[] AS v FROM facts WHERE {_USABLE}),
      c AS (SELECT a.id, least(count(*), 5) AS n_similar FROM u a JOIN u b ON a.id <> b.id AND round(list_cosine_similarity(a.v, b.v), 6) >= 0.86 GROUP BY a.id)
      SELECT n_similar, count(*) AS n_facts FROM c GROUP BY 1""",
}
