"""Queries over retrieval: bench questions against documents and messages, fact vectors against facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrava.operators import delivery, retrieval
from engrava.plans.store_sql import norm
from engrava.sources import read_table

NOW = 1678700000.0
FLOOR = 0.77


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "bench", F.col("item_id").alias("qid"), F.col("query").alias("text"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", F.col("doc_id").alias("id"), "text").where("text IS NOT NULL")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "messages", "id", "session_id", "role", "content", "timestamp").where("content IS NOT NULL")
    rows = rows.where(delivery.plain_role(F.col("role")).isin("user", "assistant"))
    return rows.select("id", delivery.session_name(F.col("session_id")).alias("session"), F.col("content").alias("text"), delivery.seconds(F.col("timestamp")).alias("sec"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    return read_table(spark, sf_dir, "facts", F.col("fact_id").alias("id"), "vector", "project").where((F.size("vector") == 64) & ok)


def q01_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth fact as a query against the global facts and those of one project."""
    facts = _vectors(spark, sf_dir)
    asked = facts.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    visible = facts.where("project IS NULL OR project = 'vaultkit'").select("id", "vector")
    return retrieval.vector_topk(asked, visible, 5).select("qid", "id", F.round("score", 4).alias("score"), "rank")


def q02_vector_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the top hits of each query pass the floor, how many it keeps out, and the best one kept out."""
    hits = q01_vector_topk(spark, sf_dir)
    return hits.groupBy("qid").agg(
        F.count_if(F.col("score") >= FLOOR).alias("n_admitted"), F.count_if(F.col("score") < FLOOR).alias("n_below"), F.max(F.when(F.col("score") < FLOOR, F.col("score"))).alias("nearest_miss")
    )


def q05_lexical_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.term_coverage(_questions(spark, sf_dir), _documents(spark, sf_dir))
    return retrieval.top(found, "rate", 10).select("qid", "id", "matched", F.round("rate", 4).alias("rate"), "rank")


def q19_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of the bench questions over user and assistant messages, scaled within each question."""
    scored = retrieval.min_max(retrieval.bm25(_questions(spark, sf_dir), _messages(spark, sf_dir)), "bm25").withColumn("shown", F.round("bm25", 4))
    return retrieval.top(scored, "shown", 10).select("qid", "id", F.col("shown").alias("bm25"), F.round("scaled", 4).alias("scaled"), "rank")


def q20_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieval.min_max(retrieval.bm25(_questions(spark, sf_dir), _messages(spark, sf_dir)), "bm25")
    times = _messages(spark, sf_dir).select("id", "sec")
    aged = scored.join(times, "id").withColumn("score", F.round(F.col("scaled") * retrieval.decay(F.lit(NOW) - F.col("sec")), 4))
    return retrieval.top(aged, "score", 10).select("qid", "id", "score", "rank")


def q22_session_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieval.bm25(_questions(spark, sf_dir), _messages(spark, sf_dir)).withColumn("score", F.round("bm25", 4))
    owned = scored.join(_messages(spark, sf_dir).select("id", "session"), "id")
    return retrieval.session_cap(owned, "score", 2, 8).select("qid", "id", "session", "score", "rank")


def _channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked, docs = _questions(spark, sf_dir), _documents(spark, sf_dir)
    lexical = retrieval.top(retrieval.term_coverage(asked, docs), "rate", 20)
    ranked = retrieval.top(retrieval.bm25(asked, docs).withColumn("score", F.round("bm25", 4)), "score", 20)
    return lexical, ranked


def q08_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical, ranked = _channels(spark, sf_dir)
    fused = retrieval.rank_fusion({"lexical": (lexical, 0.5), "bm25": (ranked, 0.5)}).withColumn("fused", F.round("fused", 4))
    return retrieval.top(fused, "fused", 10).select("qid", "id", "fused", "n_channels", "rank")


def q12_fixed_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical, ranked = _channels(spark, sf_dir)
    fused = retrieval.rank_fusion({"lexical": (lexical, 0.4), "bm25": (ranked, 0.6)}, fixed=True).withColumn("fused", F.round("fused", 4))
    return retrieval.top(fused, "fused", 10).select("qid", "id", "fused", "n_channels", "rank")


def q14_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    pool = retrieval.top(retrieval.bm25(_questions(spark, sf_dir), docs).withColumn("score", F.round("bm25", 4)), "score", retrieval.diversity_pool(5))
    return retrieval.diverse(pool.join(docs, "id"), 5, 0.7)


def q23_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    pool = retrieval.top(retrieval.bm25(_questions(spark, sf_dir), docs).withColumn("score", F.round("bm25", 4)), "score", 12)
    return retrieval.pack(pool.join(docs.select("id", F.length("text").alias("n_chars")), "id"), 1200)


def _answers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "bench", F.col("item_id").alias("qid"), F.col("answer").alias("text"), *columns)


def _ranked_documents(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The ``k`` best documents of each bench question by BM25, with their scaled score."""
    scored = retrieval.min_max(retrieval.bm25(_questions(spark, sf_dir), _documents(spark, sf_dir)), "bm25")
    return retrieval.top(scored.withColumn("score", F.round("bm25", 4)), "score", k)


def q58_eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P@1, recall@5 and reciprocal rank of BM25 over documents by split, over items whose answer is in some document; and how many items without one still get a hit."""
    holds = retrieval.covering(_documents(spark, sf_dir), _answers(spark, sf_dir))
    pool = _ranked_documents(spark, sf_dir, 5)
    hit = pool.join(holds, ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("first"))
    items = read_table(spark, sf_dir, "bench", F.col("item_id").alias("qid"), "split").join(hit, "qid", "left").join(holds.select("qid").distinct().withColumn("positive", F.lit(True)), "qid", "left")
    items = items.join(pool.select("qid").distinct().withColumn("any_hit", F.lit(True)), "qid", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    mean = lambda c: F.round(F.avg(F.when(F.col("positive"), c)), 4)
    return items.groupBy("split").agg(
        F.count("*").alias("n_items"), F.count_if("positive").alias("n_positive"), mean(F.when(F.col("first") == 1, 1.0).otherwise(0.0)).alias("p_at_1"), mean(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)).alias("recall_at_5"),
        mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.round(F.avg(F.when(~F.col("positive"), F.when(F.col("any_hit"), 1.0).otherwise(0.0))), 4).alias("negative_hit_rate"),
    )


# Marks of an answer that corrects an earlier one.
CORRECTIONS = "已改|已切|已从|不再|已停用|已撤|现已|改成|剪到|降到"


def q60_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By split: bench items whose answer can be found at all, its rank among the five best documents, and negatives ranked above it.

    An item counts if its answer is in some document (``n_decided``; ``n_undecidable`` answers correct an earlier one) and passes
    if the answer is among the three best with no negative above it; contested items have a negative that is in some document.
    """
    docs, items = _documents(spark, sf_dir), read_table(spark, sf_dir, "bench", F.col("item_id").alias("qid"), "split", "answer", "negatives")
    answers = retrieval.covering(docs, items.select("qid", F.col("answer").alias("text")))
    negatives = items.select("qid", F.posexplode("negatives").alias("n", "text")).select((F.col("qid") * 1000 + F.col("n")).alias("qid"), "text")
    # a negative's key is its item's with its place behind it
    wrong = retrieval.covering(docs, negatives).select(F.floor(F.col("qid") / 1000).alias("qid"), "id").distinct()
    pool = _ranked_documents(spark, sf_dir, 5).select("qid", "id", "rank")
    first = pool.join(answers, ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("first"))
    above = pool.join(wrong, ["qid", "id"]).join(first, "qid", "left").where("first IS NULL OR rank < first").groupBy("qid").agg(F.count("*").alias("n_above"))
    told = items.select("qid", "split", F.coalesce(F.lower("answer").rlike(CORRECTIONS), F.lit(False)).alias("corrects")).join(first, "qid", "left").join(above, "qid", "left")
    for name, there in (("grounded", answers), ("contested", wrong)):
        told = told.join(there.select("qid").distinct().withColumn(name, F.lit(True)), "qid", "left")
    decided = F.coalesce(F.col("grounded") & ~F.col("corrects"), F.lit(False))
    told = told.withColumns({"decided": decided, "contested": F.coalesce(decided & F.col("contested"), F.lit(False)), "passed": F.coalesce(decided & (F.col("first") <= 3) & F.col("n_above").isNull(), F.lit(False))})
    # at most one rank for each bench item
    ranks = F.array_sort(F.collect_list(F.when(F.col("decided"), F.col("first"))))
    share = lambda c, of: F.round(F.try_divide(F.count_if(c), F.count_if(of)), 4)
    return told.groupBy("split").agg(
        F.count("*").alias("n_items"), F.count_if("decided").alias("n_decided"), F.count_if(F.coalesce("grounded", F.lit(False)) & F.col("corrects")).alias("n_undecidable"), F.count_if(F.col("grounded").isNull()).alias("n_ungrounded"), F.count_if("contested").alias("n_contested"),
        share(F.col("decided") & F.col("first").isNotNull(), F.col("decided")).alias("answer_found"), share(F.col("decided") & (F.col("first") <= 3), F.col("decided")).alias("answer_at_3"),
        F.try_element_at(ranks, (F.floor(F.size(ranks) / 2) + 1).cast("int")).alias("median_rank"), share(F.col("passed"), F.col("decided")).alias("clean_rate"), share(F.col("passed") & F.col("contested"), F.col("contested")).alias("contested_clean_rate"),
    )


FLOORS = (0.0, 0.1, 0.2, 0.4, 0.6, 0.8)


def q59_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each floor admits of all documents that share a term with a question: hits, questions that keep one, and questions that keep their answer; ``chosen`` is the highest floor that loses no answer."""
    docs = _documents(spark, sf_dir)
    scaled = retrieval.min_max(retrieval.bm25(_questions(spark, sf_dir), docs), "bm25").select("qid", "id", F.round("scaled", 4).alias("scaled"))
    holds = retrieval.covering(docs, _answers(spark, sf_dir)).withColumn("answers", F.lit(True))
    marked = scaled.join(holds, ["qid", "id"], "left")
    floors = marked.withColumn("floor", F.explode(F.array(*[F.lit(f) for f in FLOORS]))).where("scaled >= floor")
    swept = floors.groupBy("floor").agg(F.count("*").alias("n_hits"), F.countDistinct("qid").alias("n_questions"), F.countDistinct(F.when(F.col("answers"), F.col("qid"))).alias("n_answers"))
    # one row for each floor
    lossless = F.col("n_answers") == F.max("n_answers").over(Window.partitionBy())
    return swept.withColumn("lossless", lossless).withColumn("chosen", F.col("lossless") & (F.col("floor") == F.max(F.when(F.col("lossless"), F.col("floor"))).over(Window.partitionBy())))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "facts", F.col("fact_id").alias("id"), F.col("content").alias("text")).where("text IS NOT NULL")


def q06_lexical_dismax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts for each bench question by the better of term rate and phrase rate: the ten best at the floor of 0.4, and how many lay below it."""
    found = retrieval.lexical(_questions(spark, sf_dir), _facts(spark, sf_dir)).withColumn("score", F.round("score", 4))
    below = found.groupBy("qid").agg(F.count_if(F.col("score") < 0.4).alias("n_below"))
    return retrieval.top(found.where("score >= 0.4"), "score", 10).join(below, "qid").select("qid", "id", "score", "rank", "n_below")


def q07_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by BM25 at the semantic floor, with facts of full lexical coverage that it lacks behind them, eight of a question at most."""
    asked, facts = _questions(spark, sf_dir), _facts(spark, sf_dir)
    scaled = retrieval.min_max(retrieval.bm25(asked, facts), "bm25").withColumn("score", F.round("scaled", 4)).where(F.col("score") >= FLOOR)
    return retrieval.rescue(retrieval.top(scaled, "score", 5), retrieval.lexical(asked, facts), 8)


def q16_cross_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and messages of each bench question fused by rank after each layer's own admission; a fact and the message it came from are one key."""
    asked = _questions(spark, sf_dir)
    facts = read_table(spark, sf_dir, "facts", F.col("fact_id").alias("id"), F.col("content").alias("text"), "source_rowid").where("text IS NOT NULL")
    own = retrieval.min_max(retrieval.bm25(asked, facts), "bm25").withColumn("score", F.round("scaled", 4)).where("score >= 0.1")
    own = retrieval.top(own, "score", 10).join(facts.select("id", "source_rowid"), "id")
    # facts without a source keep a key of their own, below zero
    keyed = own.select("qid", F.coalesce("source_rowid", -F.col("id")).alias("id"), "rank").groupBy("qid", "id").agg(F.min("rank").alias("rank"))
    said = retrieval.min_max(retrieval.bm25(asked, _messages(spark, sf_dir)), "bm25").withColumn("score", F.round("scaled", 4)).where("score >= 0.1")
    fused = retrieval.rank_fusion({"facts": (keyed, 1.0), "messages": (retrieval.top(said, "score", 10), 1.0)}).withColumn("fused", F.round("fused", 4))
    return retrieval.top(fused, "fused", 10).select("qid", F.col("id").alias("key"), "fused", "n_channels", "rank")


QUERIES = {f.__name__: f for f in (q01_vector_topk, q02_vector_admission, q05_lexical_coverage, q08_rank_fusion, q12_fixed_fusion, q14_diverse, q19_bm25, q20_decayed, q22_session_cap, q23_packed, q58_eval_metrics, q06_lexical_dismax, q07_rescue, q16_cross_layer, q59_threshold_sweep, q60_hard_negatives)}

_STOP = ", ".join(repr(w) for w in retrieval.STOP_TERMS)


def _tokens_sql(text: str) -> str:
    return rf"""list_concat(regexp_extract_all(regexp_replace(lower({text}), '[\x{{4E00}}-\x{{9FFF}}]+', ' ', 'g'), '[\p{{L}}\p{{N}}_]{{2,}}'),
      flatten(list_transform(regexp_extract_all({text}, '[\x{{4E00}}-\x{{9FFF}}]{{2,}}'), lambda run: list_transform(range(1, length(run)::BIGINT), lambda i: substring(run, i, 2)))))"""


def _terms_sql(table: str, key: str, text: str) -> str:
    return f"(SELECT DISTINCT {key}, term FROM (SELECT {key}, unnest({_tokens_sql(text)}) AS term FROM {table}) WHERE term NOT IN ({_STOP}))"


_MSG = r"""msg AS (
  SELECT id, nullif(regexp_replace(session_id, '^\s+|\s+$', '', 'g'), '') AS session, content AS text,
         CASE WHEN abs("timestamp") >= 1e11 THEN "timestamp" / 1000 ELSE "timestamp" END AS sec
  FROM messages WHERE content IS NOT NULL AND lower(trim(role)) IN ('user', 'human', 'assistant', 'ai', 'bot', 'model'))"""
_DOC = "docs AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)"


def _bm25_sql(source: str) -> str:
    return rf"""asked AS {_terms_sql("bench", "item_id", "query")},
    words AS (SELECT id, {_tokens_sql("text")} AS w FROM {source}),
    stats AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM words),
    tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    bm AS (SELECT item_id AS qid, id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS bm25
           FROM tf JOIN df USING (term) JOIN asked USING (term), stats GROUP BY ALL)"""


_SCALED = "ends AS (SELECT qid, min(bm25) AS lo, max(bm25) AS hi FROM bm GROUP BY qid), scaled AS (SELECT bm.*, CASE WHEN hi = lo THEN 0.8 ELSE (bm25 - lo) / (hi - lo) END AS scaled FROM bm JOIN ends USING (qid))"
_COVER = f"""cover AS (SELECT qid, id, count(*) AS matched, least(1.0, count(*) / greatest(1, least(any_value(n_terms), 3))) AS rate FROM (
    SELECT a.item_id AS qid, a.term, count(*) OVER (PARTITION BY a.item_id) AS n_terms FROM {_terms_sql("bench", "item_id", "query")} a) q
    JOIN {_terms_sql("docs", "id", "text")} d USING (term) GROUP BY qid, id)"""


def _top_sql(score: str, k: int, source: str, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, id) AS rank FROM {source}) WHERE rank <= {k}"


_USABLE = "len(vector) = 64 AND list_bool_and(list_transform(vector, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(vector, lambda x: x <> 0))"
_HITS = f"""hits AS (SELECT qid, id, round(greatest(0.0, least(1.0, 1 - (1 - cos) / 2)), 4) AS score, rank FROM (
  SELECT qid, id, cos, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank FROM (
    SELECT q.fact_id AS qid, f.fact_id AS id, round(list_cosine_similarity(q.vector::DOUBLE[], f.vector::DOUBLE[]), 6) AS cos
    FROM (SELECT * FROM facts WHERE {_USABLE} AND fact_id % 20 = 0) q, (SELECT * FROM facts WHERE {_USABLE} AND (project IS NULL OR project = 'vaultkit')) f
    WHERE q.fact_id <> f.fact_id)) WHERE rank <= 5)"""


def _fusion_sql(lexical: float, ranked: float, fixed: bool) -> str:
    most = f"{(lexical + ranked) / 61!r}" if fixed else "any_value(most)"
    return f"""WITH {_DOC}, {_bm25_sql("docs")}, {_COVER},
    both_channels AS (SELECT qid, id, rank, {lexical} AS weight FROM ({_top_sql("rate", 20, "cover", "qid, id, rank")})
      UNION ALL SELECT qid, id, rank, {ranked} FROM ({_top_sql("round(bm25, 4)", 20, "bm", "qid, id, rank")})),
    present AS (SELECT qid, sum(w) / 61 AS most FROM (SELECT DISTINCT qid, weight AS w, rank > 0 AS r FROM (SELECT qid, weight, rank FROM both_channels)) GROUP BY qid),
    fused AS (SELECT qid, id, round(least(1.0, sum(weight / (60 + rank)) / {most}), 4) AS fused, count(*) AS n_channels FROM both_channels JOIN present USING (qid) GROUP BY qid, id)
    {_top_sql("fused", 10, "fused", "qid, id, fused, n_channels, rank")}"""


_FCT = "fct AS (SELECT fact_id AS id, content AS text FROM facts WHERE content IS NOT NULL)"


def _covering_sql(source: str, table: str, key: str, answer: str) -> str:
    """Rows of ``source`` that hold the whole of an answer or half of its distinctive terms."""
    return rf"""(SELECT DISTINCT {key} AS qid, d.id FROM (SELECT id, {norm('text')} AS hay FROM {source}) d,
      (SELECT {key}, a, regexp_extract_all(a, '[a-z0-9][a-z0-9_.-]{{1,}}|[\x{{4E00}}-\x{{9FFF}}]{{2,}}') AS ts FROM (SELECT {key}, {norm(answer)} AS a FROM {table}) WHERE a <> '') q
      WHERE contains(hay, a) OR (len(ts) > 0 AND 2 * len(list_filter(ts, lambda t: contains(hay, t))) >= len(ts)))"""


def _lexical_sql(source: str) -> str:
    phrases = r"regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')"
    return rf"""{_COVER.replace('"docs"', source).replace('FROM docs)', f'FROM {source})')},
      ph AS (SELECT item_id AS qid, p, count(*) OVER (PARTITION BY item_id) AS n FROM (SELECT DISTINCT item_id, unnest({phrases}) AS p FROM bench) WHERE p NOT IN ({_STOP})),
      pc AS (SELECT qid, id, least(1.0, count(*) / greatest(1, least(any_value(n), 3))) AS rate FROM {source}, ph WHERE contains(lower(text), p) GROUP BY qid, id),
      lex AS (SELECT qid, id, max(rate) AS score FROM (SELECT qid, id, rate FROM cover UNION ALL SELECT qid, id, rate FROM pc) GROUP BY qid, id)"""


def _layered(layer: str, source: str) -> str:
    """The BM25 of one layer under names of its own, scaled as ``{layer}_s``."""
    body = _bm25_sql(source)
    for name in ("asked", "words", "stats", "tf", "df", "bm"):
        body = body.replace(f"{name} AS (", f"{layer}_{name} AS (").replace(f"FROM {name}", f"FROM {layer}_{name}").replace(f"JOIN {name} ", f"JOIN {layer}_{name} ").replace(f"), {name}\n", f"), {layer}_{name}\n").replace(f"USING (term), {name} ", f"USING (term), {layer}_{name} ")
    return f"{body}, {layer}_s AS (SELECT qid, id, round(CASE WHEN max(bm25) OVER w = min(bm25) OVER w THEN 0.8 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END, 4) AS score FROM {layer}_bm WINDOW w AS (PARTITION BY qid))"


ORACLE = {
    "q01_vector_topk": f"WITH {_HITS} SELECT qid, id, score, rank FROM hits",
    "q02_vector_admission": f"WITH {_HITS} SELECT qid, count(*) FILTER (WHERE score >= {FLOOR}) AS n_admitted, count(*) FILTER (WHERE score < {FLOOR}) AS n_below, max(score) FILTER (WHERE score < {FLOOR}) AS nearest_miss FROM hits GROUP BY qid",
    "q05_lexical_coverage": f"WITH {_DOC}, {_COVER} {_top_sql('rate', 10, 'cover', 'qid, id, matched, round(rate, 4) AS rate, rank')}",
    "q12_fixed_fusion": _fusion_sql(0.4, 0.6, True),
    "q19_bm25": f"WITH {_MSG}, {_bm25_sql('msg')}, {_SCALED} {_top_sql('round(bm25, 4)', 10, 'scaled', 'qid, id, round(bm25, 4) AS bm25, round(scaled, 4) AS scaled, rank')}",
    "q20_decayed": f"WITH {_MSG}, {_bm25_sql('msg')}, {_SCALED}, aged AS (SELECT qid, id, round(scaled * CASE WHEN sec IS NULL THEN 1 ELSE exp(-0.693 * greatest(0, {NOW} - sec) / 604800) END, 4) AS score FROM scaled JOIN msg USING (id)) {_top_sql('score', 10, 'aged', 'qid, id, score, rank')}",
    "q22_session_cap": f"""WITH {_MSG}, {_bm25_sql('msg')}, owned AS (SELECT qid, id, session, round(bm25, 4) AS score FROM bm JOIN msg USING (id)),
      capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, session ORDER BY score DESC, id) AS k FROM owned) WHERE session IS NULL OR k <= 2) {_top_sql('score', 8, 'capped', 'qid, id, session, score, rank')}""",
    "q58_eval_metrics": f"""WITH {_DOC}, {_bm25_sql('docs')}, pool AS ({_top_sql('round(bm25, 4)', 5, 'bm', 'qid, id, rank')}), holds AS {_covering_sql('docs', 'bench', 'item_id', 'answer')},
      hit AS (SELECT qid, min(rank) AS first FROM pool JOIN holds USING (qid, id) GROUP BY qid),
      items AS (SELECT split, first, item_id IN (SELECT qid FROM holds) AS positive, item_id IN (SELECT qid FROM pool) AS any_hit FROM bench LEFT JOIN hit ON qid = item_id)
      SELECT split, count(*) AS n_items, count(*) FILTER (WHERE positive) AS n_positive, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE positive), 4) AS p_at_1,
             round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE positive), 4) AS recall_at_5, round(avg(coalesce(1.0 / first, 0.0)) FILTER (WHERE positive), 4) AS mrr,
             round(avg(CASE WHEN any_hit THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT positive), 4) AS negative_hit_rate FROM items GROUP BY split""",
    "q23_packed": f"""WITH RECURSIVE {_DOC}, {_bm25_sql('docs')}, pool AS ({_top_sql('round(bm25, 4)', 12, 'bm', 'qid, id, rank')}), costs AS (SELECT qid, id, rank, ceil(length(text) / 4)::BIGINT AS cost FROM pool JOIN docs USING (id)),
      pk AS (SELECT DISTINCT qid, 0::BIGINT AS rank, 0::BIGINT AS used, []::BIGINT[] AS ids FROM costs
        UNION ALL SELECT p.qid, c.rank, CASE WHEN used + cost <= 1200 THEN used + cost ELSE used END, CASE WHEN used + cost <= 1200 THEN list_append(ids, c.id) ELSE ids END FROM pk p JOIN costs c ON c.qid = p.qid AND c.rank = p.rank + 1),
      done AS (SELECT qid, arg_max(ids, rank) AS ids, max(used) AS used FROM pk GROUP BY qid)
      SELECT qid, ids[i + 1] AS id, i::INT AS position, used FROM (SELECT *, unnest(range(len(ids))) AS i FROM done)""",
    "q59_threshold_sweep": f"""WITH {_DOC}, {_bm25_sql('docs')}, {_SCALED}, holds AS {_covering_sql('docs', 'bench', 'item_id', 'answer')},
      swept AS (SELECT floor, count(*) AS n_hits, count(DISTINCT qid) AS n_questions, count(DISTINCT CASE WHEN (qid, id) IN (SELECT (qid, id) FROM holds) THEN qid END) AS n_answers
        FROM (SELECT qid, id, round(scaled, 4) AS s FROM scaled), (SELECT unnest([{', '.join(f'{f}::DOUBLE' for f in FLOORS)}]) AS floor) WHERE s >= floor GROUP BY floor),
      l AS (SELECT *, n_answers = max(n_answers) OVER () AS lossless FROM swept) SELECT *, lossless AND floor = max(floor) FILTER (WHERE lossless) OVER () AS chosen FROM l""",
    "q60_hard_negatives": f"""WITH {_DOC}, {_bm25_sql('docs')}, pool AS ({_top_sql('round(bm25, 4)', 5, 'bm', 'qid, id, rank')}), neg AS (SELECT item_id, unnest(negatives) AS n FROM bench),
      a AS {_covering_sql('docs', 'bench', 'item_id', 'answer')}, w AS (SELECT DISTINCT qid, id FROM {_covering_sql('docs', 'neg', 'item_id', 'n')}),
      f AS (SELECT qid, min(rank) AS first FROM pool JOIN a USING (qid, id) GROUP BY qid),
      u AS (SELECT pool.qid, count(*) AS n_above FROM pool JOIN w USING (qid, id) LEFT JOIN f ON f.qid = pool.qid WHERE first IS NULL OR rank < first GROUP BY pool.qid),
      t AS (SELECT split, first, n_above, item_id IN (SELECT qid FROM a) AS g, coalesce(regexp_matches(lower(answer), '{CORRECTIONS}'), false) AS c, item_id IN (SELECT qid FROM w) AS x
            FROM bench LEFT JOIN f ON f.qid = item_id LEFT JOIN u ON u.qid = item_id),
      d AS (SELECT *, g AND NOT c AS decided, g AND NOT c AND x AS contested, coalesce(g AND NOT c AND first <= 3 AND n_above IS NULL, false) AS passed FROM t)
      SELECT split, count(*) AS n_items, count(*) FILTER (WHERE decided) AS n_decided, count(*) FILTER (WHERE g AND c) AS n_undecidable, count(*) FILTER (WHERE NOT g) AS n_ungrounded, count(*) FILTER (WHERE contested) AS n_contested,
        round(count(*) FILTER (WHERE decided AND first IS NOT NULL) / nullif(count(*) FILTER (WHERE decided), 0), 4) AS answer_found, round(count(*) FILTER (WHERE decided AND first <= 3) / nullif(count(*) FILTER (WHERE decided), 0), 4) AS answer_at_3,
        list_sort(list(first) FILTER (WHERE decided AND first IS NOT NULL))[(count(*) FILTER (WHERE decided AND first IS NOT NULL) // 2 + 1)::INT] AS median_rank,
        round(count(*) FILTER (WHERE passed) / nullif(count(*) FILTER (WHERE decided), 0), 4) AS clean_rate, round(count(*) FILTER (WHERE passed AND contested) / nullif(count(*) FILTER (WHERE contested), 0), 4) AS contested_clean_rate FROM d GROUP BY split""",
    "q06_lexical_dismax": f"""WITH {_FCT}, {_lexical_sql('fct')}, s AS (SELECT qid, id, round(score, 4) AS score FROM lex), b AS (SELECT qid, count(*) FILTER (WHERE score < 0.4) AS n_below FROM s GROUP BY qid)
      SELECT qid, id, score, rank, n_below FROM ({_top_sql('score', 10, '(SELECT * FROM s WHERE score >= 0.4)', 'qid, id, score, rank')}) JOIN b USING (qid)""",
    "q07_rescue": f"""WITH {_FCT}, {_bm25_sql('fct')}, {_SCALED}, {_lexical_sql('fct')}, h AS ({_top_sql('score', 5, f'(SELECT qid, id, round(scaled, 4) AS score FROM scaled WHERE round(scaled, 4) >= {FLOOR})', 'qid, id, rank')}),
      x AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS nth FROM lex WHERE score >= 1 AND (qid, id) NOT IN (SELECT (qid, id) FROM h))
      SELECT qid, id, rank, false AS rescued FROM h UNION ALL SELECT qid, id, coalesce(last, 0) + nth, true FROM x LEFT JOIN (SELECT qid, max(rank) AS last FROM h GROUP BY qid) USING (qid) WHERE coalesce(last, 0) + nth <= 8""",
    "q16_cross_layer": f"""WITH {_FCT}, {_MSG}, {_layered('f', 'fct')}, {_layered('m', 'msg')},
      fk AS (SELECT qid, coalesce(source_rowid, -r.id) AS id, min(rank) AS rank FROM ({_top_sql('score', 10, '(SELECT * FROM f_s WHERE score >= 0.1)', 'qid, id, rank')}) r JOIN facts ON fact_id = r.id GROUP BY 1, 2),
      ch AS (SELECT qid, id, rank FROM fk UNION ALL SELECT qid, id, rank FROM ({_top_sql('score', 10, '(SELECT * FROM m_s WHERE score >= 0.1)', 'qid, id, rank')})),
      p AS (SELECT qid, count(*) / 61 AS most FROM (SELECT DISTINCT qid, 'f' FROM fk UNION ALL SELECT DISTINCT qid, 'm' FROM m_s WHERE score >= 0.1) GROUP BY qid),
      z AS (SELECT qid, id, round(least(1.0, sum(1 / (60 + rank)) / any_value(most)), 4) AS fused, count(*) AS n_channels FROM ch JOIN p USING (qid) GROUP BY qid, id)
      {_top_sql('fused', 10, 'z', 'qid, id AS key, fused, n_channels, rank')}""",
}
ORACLE["q08_rank_fusion"] = _fusion_sql(0.5, 0.5, False).replace(
    "SELECT qid, sum(w) / 61 AS most FROM (SELECT DISTINCT qid, weight AS w, rank > 0 AS r FROM (SELECT qid, weight, rank FROM both_channels)) GROUP BY qid",
    "SELECT qid, sum(w) / 61 AS most FROM (SELECT qid, 0.5 AS w FROM cover GROUP BY qid UNION ALL SELECT qid, 0.5 AS w FROM bm GROUP BY qid) GROUP BY qid",
)
