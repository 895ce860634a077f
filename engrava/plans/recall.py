"""Queries that compose the layers: admission, link audit, threshold sweep, hard negatives, and recall over all layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrava.functions.text import INVISIBLE, normalised
from engrava.operators import gates, retrieval
from engrava.plans import retrieval as plans
from engrava.plans.store_sql import _WEIGHT, norm
from engrava.session import small
from engrava.sources import read_table


def q04_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known entities as whole-query substrings of message texts: score 0.5 and 0.1 for each occurrence, 1 at most."""
    entities = read_table(spark, sf_dir, "entity_map", "entity").where("length(entity) > 0").distinct()
    rows = read_table(spark, sf_dir, "messages", "id", F.lower("content").alias("text")).where("text IS NOT NULL")
    met = retrieval.containing(rows, entities.select(F.lower("entity").alias("part"))).join(small(entities.withColumn("part", F.lower("entity"))), "part")
    score = F.least(F.lit(1.0), 0.5 + 0.1 * F.col("times"))
    return met.select("entity", "id", F.round(score, 4).alias("score"))


def q21_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideograph segments of bench answers in documents: (0.5 + 0.3 matched / segments) with decay, the ten best of each question."""
    runs = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"([\x{4E00}-\x{9FFF}]{2,})"), 1))
    asked = read_table(spark, sf_dir, "bench", F.col("item_id").alias("qid"), "answer").select("qid", runs.alias("runs")).where(F.size("runs") > 0)
    segments = asked.select("qid", F.size("runs").alias("n"), F.explode("runs").alias("segment"))
    docs = read_table(spark, sf_dir, "documents", F.col("doc_id").alias("id"), "text", (F.unix_micros(F.col("updated").cast("timestamp")) / 1e6).alias("sec")).where("text IS NOT NULL")
    found = retrieval.containing(docs, segments.select(F.col("segment").alias("part"))).join(small(segments.withColumnRenamed("segment", "part")), "part")
    met = found.groupBy("qid", "id", "n").agg(F.count("*").alias("matched")).join(docs.select("id", "sec"), "id")
    scored = met.withColumn("score", F.round((0.5 + 0.3 * F.col("matched") / F.col("n")) * retrieval.decay(F.lit(plans.NOW) - F.col("sec")), 4))
    return retrieval.top(scored, "score", 10).select("qid", "id", "matched", "score", "rank")


def q41_fact_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and message texts by the first rule that rejects them."""
    texts = read_table(spark, sf_dir, "facts", F.lit("facts").alias("layer"), "content").unionByName(read_table(spark, sf_dir, "messages", F.lit("messages").alias("layer"), "content"))
    return texts.groupBy("layer", F.coalesce(gates.rejection(F.col("content")), F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n_texts"), F.sum(gates.evidence(F.col("content"))).alias("evidence"))


def q64_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over facts, messages and documents: each layer's five best, scaled, one row for equal texts, the ten best of each question."""
    asked = plans._questions(spark, sf_dir)
    layers = {
        "facts": read_table(spark, sf_dir, "facts", F.col("fact_id").alias("id"), F.col("content").alias("text")).where("text IS NOT NULL"),
        "messages": plans._messages(spark, sf_dir).select("id", "text"),
        "documents": plans._documents(spark, sf_dir),
    }
    rows = None
    for layer, texts in layers.items():
        scaled = retrieval.min_max(retrieval.bm25(asked, texts), "bm25").withColumn("score", F.round("scaled", 4))
        one = retrieval.top(scaled, "score", 5).drop("rank").join(texts, "id").select("qid", F.lit(layer).alias("layer"), "id", "score", F.md5(normalised(F.col("text"))).alias("same"))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("qid", "same").agg(F.max_by(F.struct("layer", "id", "score"), F.struct("score", F.negate("id"), "layer")).alias("b")).select("qid", "b.*")
    return _ten_best(best)


def _ten_best(best: DataFrame) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "layer", "id")
    return best.withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 10").select("qid", "layer", "id", "score", "rank")


QUERIES = {n: f for n, f in dict(globals()).items() if n.startswith("q") and n[1:3].isdigit()}


def _gate_sql() -> str:
    text = "trim(content)"
    rules = " ".join(f"WHEN regexp_matches({text}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in gates.RULES)
    found = " + ".join(f"coalesce(regexp_matches(content, '{k}'), false)::INT" for k in gates.EVIDENCE)
    return f"""SELECT layer, CASE WHEN content IS NULL OR NOT regexp_matches(content, '[^{INVISIBLE}]') THEN 'empty' WHEN {_WEIGHT.format(text)} < 6 THEN 'short' WHEN length({text}) > 500 THEN 'long' {rules} ELSE 'admitted' END AS reason,
        count(*) AS n_texts, sum({found})::BIGINT AS evidence FROM (SELECT 'facts' AS layer, content FROM facts UNION ALL SELECT 'messages', content FROM messages) GROUP BY 1, 2"""


def _recall_sql() -> str:
    parts, union = [plans._MSG, plans._DOC, plans._FCT], []
    for layer, source in (("facts", "fct"), ("messages", "msg"), ("documents", "docs")):
        parts.append(plans._layered(layer, source))
        union.append(f"SELECT qid, '{layer}' AS layer, id, score, md5({norm('text')}) AS same FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM {layer}_s) JOIN {source} USING (id) WHERE r <= 5")
    return f"""WITH {', '.join(parts)}, rows_ AS ({' UNION ALL '.join(union)}),
      one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, same ORDER BY score DESC, id, layer DESC) AS k FROM rows_) WHERE k = 1)
      SELECT qid, layer, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, layer, id) AS rank FROM one) WHERE rank <= 10"""


ORACLE = {
    "q04_substring": """SELECT entity, id, round(least(1.0, 0.5 + 0.1 * ((length(lower(content)) - length(replace(lower(content), lower(entity), ''))) / length(entity))::BIGINT)::DOUBLE, 4) AS score
        FROM messages, (SELECT DISTINCT entity FROM entity_map WHERE length(entity) > 0) WHERE contains(lower(content), lower(entity))""",
    "q21_segments": rf"""WITH dated AS (SELECT doc_id AS id, text, epoch_us(updated) / 1e6 AS sec FROM documents WHERE text IS NOT NULL), asked AS (SELECT item_id AS qid, list_distinct(regexp_extract_all(answer, '[\x{{4E00}}-\x{{9FFF}}]{{2,}}')) AS runs FROM bench),
        seg AS (SELECT qid, len(runs) AS n, unnest(runs) AS segment FROM asked),
        met AS (SELECT qid, id, n, sec, count(*) AS matched FROM dated JOIN seg ON contains(text, segment) GROUP BY ALL),
        scored AS (SELECT qid, id, matched, round((0.5 + 0.3 * matched / n) * CASE WHEN sec IS NULL THEN 1 ELSE exp(-0.693 * greatest(0, {plans.NOW} - sec) / 604800) END, 4) AS score FROM met)
        {plans._top_sql('score', 10, 'scored', 'qid, id, matched, score, rank')}""",
    "q41_fact_gate": _gate_sql(),
    "q64_recall": _recall_sql(),
}
