"""Queries over upkeep: what is kept, pruned, sampled and recent, graph sizes, and simple term matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrava.functions import notes as note
from engrava.functions import text
from engrava.operators import delivery, gates, retrieval
from engrava.plans import retrieval as plans
from engrava.plans import store_sql as sql
from engrava.sources import read_table


def q17_prompt_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two facts that share most terms with each question, the older first where they share as many."""
    asked, facts = plans._questions(spark, sf_dir), read_table(spark, sf_dir, "facts", F.col("fact_id").alias("id"), F.col("content").alias("text"), "timestamp")
    found = retrieval.term_coverage(asked, facts.where("text IS NOT NULL")).select("qid", "id", "matched").join(facts.select("id", F.coalesce("timestamp", F.lit("")).alias("t")), "id")
    order = Window.partitionBy("qid").orderBy(F.desc("matched"), "t", "id")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 2").select("qid", "id", "matched", "rank")


def q42_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that hold a name of the list, whatever its case."""
    rows = read_table(spark, sf_dir, "messages", "id", F.lower("content").alias("text"))
    return retrieval.containing(rows, read_table(spark, sf_dir, "entity_map", F.lower("entity").alias("part"))).groupBy("id").agg(F.count("*").alias("n_names"))


def q43_desensitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that hold a name of the list, with placeholders in place of the names, as fingerprints."""
    texts = read_table(spark, sf_dir, "messages", "id", F.col("content").alias("text"))
    return gates.desensitised(texts, read_table(spark, sf_dir, "entity_map", "entity", "placeholder")).select("id", F.md5("text").alias("text_md5"))


def q51_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 300 user and assistant rows of the last seven days of the feed: a report with this limit."""
    rows = read_table(spark, sf_dir, "messages", "id", "role", "timestamp").select("id", delivery.plain_role(F.col("role")).alias("plain_role"), delivery.seconds(F.col("timestamp")).alias("sec"))
    last = rows.agg(F.max("sec").alias("last"))
    kept = rows.where(F.col("plain_role").isin("user", "assistant")).crossJoin(F.broadcast(last)).where("sec >= last - 7 * 86400")
    return kept.orderBy(F.desc("sec"), F.desc("id")).limit(300).select("id", "plain_role")


def q52_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of each source as dated snapshots: kept are the newest seven, the newest of each of the latest three months, and milestones; by how many of each source."""
    rows = read_table(spark, sf_dir, "documents", "doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), "path", F.col("updated").cast("timestamp").alias("at"))
    month = F.date_format("at", "yyyy-MM")
    newest = [F.desc_nulls_last("at"), F.desc("doc_id")]
    told = rows.select("doc_id", "source", "path", "at", month.alias("month"))
    placed = told.withColumns({"nth": F.row_number().over(Window.partitionBy("source").orderBy(*newest)), "in_month": F.row_number().over(Window.partitionBy("source", "month").orderBy(*newest)), "month_nth": F.dense_rank().over(Window.partitionBy("source").orderBy(F.desc_nulls_last("month")))})
    monthly = F.col("month").isNotNull() & (F.col("month_nth") <= 3) & (F.col("in_month") == 1)
    kept = (F.col("nth") <= 7) | monthly | F.coalesce(F.col("path").rlike("release|milestone"), F.lit(False))
    return placed.groupBy("source").agg(F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_dropped"), F.min(F.when(kept, F.col("doc_id"))).alias("first_kept"))


def q53_valuable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten long user rows that state a rule of each session, in order, as one text's fingerprint."""
    rows = read_table(spark, sf_dir, "messages", "id", "session_id", "role", "content", "timestamp").where("content IS NOT NULL")
    good = (delivery.plain_role(F.col("role")) == "user") & (text.weighted_length(F.col("content")) >= 50) & F.lower("content").rlike(r"\b(always|never|must|prefers?|remember|because)\b|因为|除非|记住")
    told = rows.where(good).select(delivery.session_name(F.col("session_id")).alias("session_id"), "id", F.coalesce(delivery.seconds(F.col("timestamp")), F.lit(float("inf"))).alias("sec"), "content").where("session_id IS NOT NULL")
    first = told.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("sec", "id"))).where("place <= 10")
    # at most ten rows of a session
    combined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda x: x.content), "\n")
    return first.groupBy("session_id").agg(F.count("*").alias("n_rows"), F.md5(combined).alias("text_md5"))


def q54_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty distinct facts in the order of a seeded hash: the same sample in every run."""
    rows = read_table(spark, sf_dir, "facts", "content").where("content IS NOT NULL").select(F.md5(F.concat(F.lit("17|"), "content")).alias("h")).distinct()
    return rows.orderBy("h").limit(20)


def q67_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the note graph with the number of notes at them: tags, and targets of links."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text").where("text IS NOT NULL")
    edges = docs.select("doc_id", F.lit("tag").alias("kind"), F.explode(note.tags(F.col("text"))).alias("node")).unionByName(docs.select("doc_id", F.lit("link").alias("kind"), F.explode(note.links(F.col("text"))).alias("node")))
    return edges.groupBy("kind", "node").agg(F.countDistinct("doc_id").alias("n_notes"))


def q69_term_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by how many of a question's terms stand in title and body: the plain fallback, ten best."""
    asked = plans._questions(spark, sf_dir).select("qid", F.explode(retrieval.phrases(F.col("text"))).alias("part"))
    texts = read_table(spark, sf_dir, "documents", F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    # a function word has no weight here, so what is left are the telling parts
    met = retrieval.containing(texts, asked.select("part")).join(F.broadcast(asked) if retrieval.is_small(asked) else asked, "part").groupBy("qid", "id").agg(F.count("*").alias("n"))
    return retrieval.top(met, "n", 10).select("qid", "id", "n", "rank")


def q70_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes over a budget of 200 tokens by language: how many, and the characters cut."""
    cut = text.truncated(F.col("text"), 200, "")
    return read_table(spark, sf_dir, "documents", "lang", "text").where("text IS NOT NULL").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count_if(F.length("text") > F.length(cut)).alias("n_cut"), F.sum(F.length("text") - F.length(cut)).alias("chars_cut"))


def q71_discriminability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the floors of 0.2 and 0.4: hits that answer and hits that do not which the higher floor drops, and the median score of either."""
    docs = plans._documents(spark, sf_dir)
    scaled = retrieval.min_max(retrieval.bm25(plans._questions(spark, sf_dir), docs), "bm25").select("qid", "id", F.round("scaled", 4).alias("s"))
    marked = scaled.join(retrieval.covering(docs, plans._answers(spark, sf_dir)).withColumn("answers", F.lit(True)), ["qid", "id"], "left").withColumn("answers", F.coalesce("answers", F.lit(False)))
    return marked.where("s >= 0.2").groupBy("answers").agg(F.count("*").alias("n_low"), F.count_if(F.col("s") < 0.4).alias("n_dropped"), F.round(F.count_if(F.col("s") < 0.4) / F.count("*"), 4).alias("drop_ratio"), F.round(F.percentile("s", 0.5), 4).alias("median"))


QUERIES = {n: f for n, f in dict(globals()).items() if n.startswith("q") and n[1:3].isdigit()}

_GOOD = rf"""{sql._ROLE} = 'user' AND {sql._WEIGHT.format('content')} >= 50 AND regexp_matches(lower(content), '\b(always|never|must|prefers?|remember|because)\b|因为|除非|记住')"""
_HOLDS = plans._covering_sql("docs", "bench", "item_id", "answer")

ORACLE = {
    "q17_prompt_match": f"""WITH {plans._FCT}, {plans._COVER.replace('JOIN ' + plans._terms_sql('docs', 'id', 'text'), 'JOIN ' + plans._terms_sql('fct', 'id', 'text'))}
      SELECT qid, id, matched, rank FROM (SELECT qid, c.id, matched, row_number() OVER (PARTITION BY qid ORDER BY matched DESC, coalesce("timestamp", ''), c.id) AS rank FROM cover c JOIN facts ON fact_id = c.id) WHERE rank <= 2""",
    "q42_pruned": "SELECT id, count(*) AS n_names FROM messages, (SELECT DISTINCT lower(entity) AS e FROM entity_map WHERE length(entity) > 0) WHERE contains(lower(content), e) GROUP BY 1",
    "q51_recent": f"""WITH r AS (SELECT id, {sql._ROLE} AS plain_role, {sql._SEC} AS sec FROM messages)
      SELECT id, plain_role FROM r WHERE plain_role IN ('user', 'assistant') AND sec >= (SELECT max(sec) FROM r) - 7 * 86400 ORDER BY sec DESC, id DESC LIMIT 300""",
    "q52_snapshots": """WITH t AS (SELECT doc_id, coalesce(source, 'unknown') AS source, path, updated AS made, strftime(updated, '%Y-%m') AS month FROM documents),
      p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY made DESC NULLS LAST, doc_id DESC) AS nth, row_number() OVER (PARTITION BY source, month ORDER BY made DESC NULLS LAST, doc_id DESC) AS in_month, dense_rank() OVER (PARTITION BY source ORDER BY month DESC NULLS LAST) AS month_nth FROM t),
      k AS (SELECT *, nth <= 7 OR (month IS NOT NULL AND month_nth <= 3 AND in_month = 1) OR coalesce(regexp_matches(path, 'release|milestone'), false) AS kept FROM p)
      SELECT source, count(*) FILTER (WHERE kept) AS n_kept, count(*) FILTER (WHERE NOT kept) AS n_dropped, min(doc_id) FILTER (WHERE kept) AS first_kept FROM k GROUP BY source""",
    "q53_valuable_texts": f"""WITH g AS (SELECT {sql._SID} AS session_id, id, coalesce({sql._SEC}, 'infinity'::DOUBLE) AS sec, content FROM messages WHERE content IS NOT NULL AND {_GOOD}),
      f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sec, id) AS place FROM g WHERE session_id IS NOT NULL)
      SELECT session_id, count(*) AS n_rows, md5(string_agg(content, chr(10) ORDER BY place)) AS text_md5 FROM f WHERE place <= 10 GROUP BY session_id""",
    "q54_sample": "SELECT DISTINCT md5('17|' || content) AS h FROM facts WHERE content IS NOT NULL ORDER BY h LIMIT 20",
    "q67_graph": f"SELECT kind, node, count(DISTINCT doc_id) AS n_notes FROM (SELECT doc_id, 'tag' AS kind, unnest({sql._TAGS}) AS node FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'link', unnest({sql._LINKS}) FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2",
    "q69_term_count": rf"""WITH a AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS p FROM bench), m AS (SELECT qid, doc_id AS id, count(*) AS n FROM documents, a WHERE p NOT IN ({plans._STOP}) AND contains(lower(text), p) GROUP BY 1, 2)
      {plans._top_sql('n', 10, 'm', 'qid, id, n, rank')}""",
    "q70_truncated": "SELECT coalesce(lang, 'unknown') AS lang, count(*) FILTER (WHERE length(text) > 600) AS n_cut, sum(greatest(length(text) - 600, 0))::BIGINT AS chars_cut FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "q71_discriminability": f"""WITH {plans._DOC}, {plans._bm25_sql('docs')}, {plans._SCALED}, h AS {_HOLDS}, m AS (SELECT round(scaled, 4) AS s, (qid, id) IN (SELECT (qid, id) FROM h) AS answers FROM scaled)
      SELECT answers, count(*) AS n_low, count(*) FILTER (WHERE s < 0.4) AS n_dropped, round(count(*) FILTER (WHERE s < 0.4) / count(*), 4) AS drop_ratio, round(quantile_cont(s, 0.5), 4) AS median FROM m WHERE s >= 0.2 GROUP BY answers""",
}
