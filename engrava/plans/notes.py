"""Queries over notes: search by keyword, identifiers and a second channel, hints, related and contained notes, links, sentences and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.functions import notes as note
from engrava.functions import text
from engrava.operators import delivery, notes, retrieval, store
from engrava.plans import retrieval as plans
from engrava.plans import store_sql as sql
from engrava.sources import read_table

MIN_SCORE, MIN_KEYWORD = 0.45, 0.35


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.read_notes(read_table(spark, sf_dir, "documents", "doc_id", "path", "text"))


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notes.keyword(plans._questions(spark, sf_dir), notes.live(_notes(spark, sf_dir)))
    return found.withColumns({c: F.round(c, 4) for c in ("raw", "exact", "keyword")})


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live notes by keyword evidence and, as the second channel, by the scaled BM25 of their bodies; empty bodies are not in that channel."""
    bodies = notes.live(_notes(spark, sf_dir)).where("length(trim(body)) > 0").select("id", F.col("body").alias("text"))
    second = retrieval.min_max(retrieval.bm25(plans._questions(spark, sf_dir), bodies), "bm25").select("qid", "id", F.round("scaled", 4).alias("score"))
    return notes.fuse(_keywords(spark, sf_dir), second).withColumn("score", F.round("score", 4))


def q09_note_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top(_keywords(spark, sf_dir), "keyword", 10).select("qid", "id", "raw", "exact", "keyword", "rank")


def q10_note_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that hold an identifier of the question."""
    return retrieval.top(_keywords(spark, sf_dir).where("exact > 0"), "exact", 10).select("qid", "id", "exact", "rank")


def q11_note_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best notes by the fused score, ranked with the use of a note but scored without it."""
    used = store.usage(read_table(spark, sf_dir, "events", "user_id", "ts"), "user_id", "ts").select(F.col("key").alias("id"), "hits")
    ranked = _fused(spark, sf_dir).join(used, "id", "left").withColumn("order", F.round(F.least(F.lit(1.0), F.col("score") * notes.affinity(F.col("hits"))), 6))
    return retrieval.top(ranked, "order", 10).select("qid", "id", "keyword", "semantic", "score", "order", "rank")


def q12_note_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and live notes in each section and status."""
    told = _notes(spark, sf_dir)
    return told.groupBy("section", F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n_notes"), F.count_if(F.size("tags") > 0).alias("n_tagged"))


def q13_related_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.related(notes.live(_notes(spark, sf_dir)).select("id", "tags"))


def q15_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and notes' titles as queries: their mode and number of identifiers."""
    asked = plans._questions(spark, sf_dir).select(F.lit("bench").alias("origin"), "text").unionByName(_notes(spark, sf_dir).select(F.lit("titles").alias("origin"), F.col("title").alias("text")))
    return asked.groupBy("origin", notes.mode(F.col("text")).alias("mode")).agg(F.count("*").alias("n"), F.sum(F.size(notes.exact_terms(F.col("text")))).alias("n_terms"))


def q18_note_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three notes to hint at for each question: a pool of thirty by the fused score, admitted by either corridor, ordered by the better score."""
    pool = retrieval.top(_fused(spark, sf_dir), "score", 30).drop("rank")
    return retrieval.top(notes.admit(pool, MIN_SCORE, MIN_KEYWORD), "order", 3).select("qid", "id", "via", "order", "rank")


def q27_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts beyond a hundred of their agent, the least used first."""
    used = store.usage(read_table(spark, sf_dir, "events", "user_id", "ts"), "user_id", "ts").select("key", F.unix_micros(F.col("last_used").cast("timestamp")).alias("last_used"))
    return notes.evicted(read_table(spark, sf_dir, "facts", "fact_id", "agent", "timestamp"), used, 100)


def q31_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.contained(_notes(spark, sf_dir).select("id", "body"))


def q33_link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of live notes by what they point at, and live notes without any."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "path", "text").where("text IS NOT NULL")
    c = F.col("text")
    told = docs.select(F.col("doc_id").alias("id"), F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("stem"), note.title(c).alias("title"), note.flow_list(c, "aliases").alias("aliases"), F.concat(note.tags(c), note.flow_list(c, "concepts")).alias("concepts"), F.lower(F.trim(note.field(c, "status"))).alias("status"))
    return notes.link_audit(told, docs.select(F.col("doc_id").alias("id"), F.explode(note.links(c)).alias("target")))


def q45_sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of messages by role."""
    rows = read_table(spark, sf_dir, "messages", "role", "content").select(F.coalesce(delivery.plain_role(F.col("role")), F.lit("unknown")).alias("plain_role"), F.explode(text.sentences(F.col("content"))).alias("s"))
    return rows.groupBy("plain_role").agg(F.count("*").alias("n_sentences"), F.countDistinct("s").alias("n_distinct"), F.sum(F.length("s")).alias("n_chars"), F.count_if(F.col("s").rlike("[?？]$")).alias("n_questions"))


def q47_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and candidates that are pages, as text."""
    pages = read_table(spark, sf_dir, "messages", F.lit("messages").alias("tbl"), F.col("id").cast("string").alias("id"), "content").unionByName(read_table(spark, sf_dir, "candidates", F.lit("candidates").alias("tbl"), "id", "content"))
    return pages.where(F.col("content").rlike(r"</?[A-Za-z][^<>]*>")).select("tbl", "id", text.html_text(F.col("content")).alias("plain"))


def q61_gold_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bench items as evaluation entries, the development part first, by why they are dropped."""
    items = read_table(spark, sf_dir, "bench", F.col("item_id").alias("item"), F.col("split").alias("part"), F.when(F.col("split") == "dev", 0).otherwise(1).alias("priority"), "query", F.col("kind").alias("title"))
    return notes.gold_kept(items)


QUERIES = {n: f for n, f in dict(globals()).items() if n.startswith("q") and n[1:3].isdigit()}

_NOTE = rf"""note AS (SELECT *, concat_ws(' ', title, nullif(array_to_string(tags, ' '), ''), nullif(array_to_string(concepts, ' '), ''), category) AS short FROM (
  SELECT doc_id AS id, path, split_part(path, '/', 1) AS section, {sql._TITLE} AS title, {sql._TAGS} AS tags, {sql.flow('concepts')} AS concepts, {sql.flow('aliases')} AS aliases, {sql._field('category')} AS category, {sql._BODY} AS body, lower(trim({sql._field('status')})) AS status, text
  FROM documents WHERE text IS NOT NULL))"""
_LIVE = "live AS (SELECT * FROM note WHERE coalesce(status, '') <> 'archived')"


def _pairs(c: str) -> str:
    return f"list_distinct(list_transform(range(1, length({c})::BIGINT), lambda i: substring({c}, i, 2)))"


def _exact(c: str) -> str:
    found = ", ".join(f"coalesce(regexp_extract_all({c}, '{p.replace(chr(39), chr(39) * 2)}', 1), [])" for p in notes.IDENTIFIERS)
    return f"list_distinct(list_filter(list_transform(flatten([{found}]), lambda t: lower(trim(t))), lambda t: t <> ''))"


_KEYWORD = f"""asked_q AS (SELECT item_id AS qid, lower(trim(query)) AS q, {_pairs('lower(trim(query))')} AS qg, {_exact('query')} AS terms FROM bench WHERE trim(query) <> ''),
  told AS (SELECT id, lower(title) AS title, lower(short) AS short, lower(body) AS body, {_pairs('lower(short)')} AS sg FROM live),
  kw0 AS (SELECT qid, id, CASE WHEN contains(title, q) THEN 5 ELSE 0 END + CASE WHEN contains(short, q) THEN 3 ELSE 0 END + CASE WHEN contains(body, q) THEN 2 ELSE 0 END + CASE WHEN len(qg) > 0 THEN len(list_intersect(qg, sg)) / len(qg) * 2.0 ELSE 0 END AS raw,
    CASE WHEN len(terms) > 0 THEN list_sum(list_transform(terms, lambda t: CASE WHEN contains(title, t) THEN 1.0 WHEN contains(short, t) THEN 0.95 WHEN contains(body, t) THEN 0.72 ELSE 0 END))::DOUBLE / len(terms) ELSE 0 END AS exact FROM told, asked_q),
  kw AS (SELECT qid, id, round(raw, 4) AS raw, round(exact, 4) AS exact, round(greatest(least(raw / 5, 1), exact), 4) AS keyword FROM kw0 WHERE greatest(raw, exact) > 0)"""
_FUSED = f"""bodies AS (SELECT id, body AS text FROM live WHERE length(trim(body)) > 0), {plans._bm25_sql('bodies')}, {plans._SCALED},
  fused AS (SELECT qid, id, coalesce(keyword, 0) AS keyword, coalesce(semantic, 0) AS semantic, round((coalesce(keyword, 0) * 0.4 + coalesce(semantic, 0) * 0.6) / 1.0, 4) AS score
    FROM kw FULL JOIN (SELECT qid, id, round(scaled, 4) AS semantic FROM scaled) USING (qid, id))"""
_MODE = f"CASE WHEN len({_exact('q')}) > 0 THEN 'exact' " + " ".join(f"WHEN regexp_matches(lower(q), '{'|'.join(cues)}') THEN '{name}'" for name, cues in notes.CUES.items()) + " ELSE 'general' END"
_SPACE = f"'^[{text.INVISIBLE}]+|[{text.INVISIBLE}]+$', '', 'g'"
_SENTENCES = rf"""list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(content, '([。！？；])', E'\\1\n', 'g'), '([.!?])(\s+[A-Z0-9\x{{4E00}}-\x{{9FFF}}])', E'\\1\n\\2', 'g'), '\n+'),
  lambda s: regexp_replace(regexp_replace(regexp_replace(s, {_SPACE}), '[.!。！？；]+\s*$', ''), {_SPACE})), lambda s: s <> '')"""


def _page() -> str:
    c = "content"
    for name in text.NOISE:
        c = f"regexp_replace({c}, '(?is)<{name}[^>]*>.*?</{name}>', ' ', 'g')"
    c = rf"regexp_replace(regexp_replace({c}, '(?i)</?(?:{text.BLOCKS})[^>]*>', E'\n', 'g'), '<[^>]+>', ' ', 'g')"
    for entity, plain in text.ENTITIES:
        c = f"replace({c}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return rf"regexp_replace(regexp_replace(regexp_replace({c}, '[ \t\r]+', ' ', 'g'), '\n\s*\n+', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')"


def _key() -> str:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(ord(c) - 0xFEE0) for c in wide).replace("'", "''")
    c = f"lower(translate(coalesce(query, ''), '{wide}', '{plain}'))"
    for pattern in notes.VARIABLE:
        c = f"regexp_replace({c}, '{pattern}', ' ', 'g')"
    return rf"regexp_replace({c}, '[^\p{{L}}\p{{N}}_]+', '', 'g')"


ORACLE = {
    "q09_note_keyword": f"WITH {_NOTE}, {_LIVE}, {_KEYWORD} {plans._top_sql('keyword', 10, 'kw', 'qid, id, raw, exact, keyword, rank')}",
    "q10_note_exact": f"WITH {_NOTE}, {_LIVE}, {_KEYWORD} {plans._top_sql('exact', 10, '(SELECT * FROM kw WHERE exact > 0)', 'qid, id, exact, rank')}",
    "q11_note_search": f"""WITH {_NOTE}, {_LIVE}, {_KEYWORD}, {_FUSED}, used AS (SELECT user_id AS id, count(*) AS hits FROM events WHERE user_id IS NOT NULL GROUP BY 1),
      o AS (SELECT f.*, round(least(1.0, score * least(1.15, 1 + 0.15 * ln(1 + coalesce(hits, 0)) / ln(9))), 6) AS "order" FROM fused f LEFT JOIN used USING (id)) {plans._top_sql('"order"', 10, 'o', 'qid, id, keyword, semantic, score, "order", rank')}""",
    "q12_note_sections": f"WITH {_NOTE} SELECT section, coalesce(status, 'none') AS status, count(*) AS n_notes, count(*) FILTER (WHERE len(tags) > 0) AS n_tagged FROM note GROUP BY 1, 2",
    "q13_related_notes": f"""WITH {_NOTE}, {_LIVE}, t AS (SELECT DISTINCT id, lower(trim(unnest(tags))) AS tag FROM live), p AS (SELECT a.id, b.id AS other, count(*) AS shared FROM t a JOIN t b ON a.tag = b.tag AND a.id <> b.id GROUP BY 1, 2)
      SELECT id, other, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, other) AS rank FROM p) WHERE rank <= 5""",
    "q15_routes": f"WITH {_NOTE}, a AS (SELECT 'bench' AS origin, query AS q FROM bench UNION ALL SELECT 'titles', title FROM note) SELECT origin, {_MODE} AS mode, count(*) AS n, sum(least(len({_exact('q')}), 12))::BIGINT AS n_terms FROM a GROUP BY 1, 2",
    "q18_note_hints": f"""WITH {_NOTE}, {_LIVE}, {_KEYWORD}, {_FUSED}, pool AS ({plans._top_sql('score', 30, 'fused', 'qid, id, keyword, score')}),
      a AS (SELECT qid, id, CASE WHEN score >= {MIN_SCORE} THEN 'fused' WHEN keyword >= {MIN_KEYWORD} THEN 'keyword' END AS via, greatest(score, keyword) AS "order" FROM pool) {plans._top_sql('"order"', 3, '(SELECT * FROM a WHERE via IS NOT NULL)', 'qid, id, via, "order", rank')}""",
    "q27_evicted": """WITH u AS (SELECT user_id AS fact_id, max(epoch_us(ts)) AS last_used FROM events WHERE user_id IS NOT NULL GROUP BY 1), t AS (SELECT f.fact_id, coalesce(agent, '') AS agent, coalesce("timestamp", '') AS ts, coalesce(last_used, 0) AS last_used FROM facts f LEFT JOIN u USING (fact_id))
      SELECT fact_id, agent, last_used FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY last_used DESC, ts DESC, fact_id DESC) AS place FROM t) WHERE place > 100 AND EXISTS (SELECT 1 FROM u)""",
    "q31_contained": f"""WITH {_NOTE}, b AS (SELECT id, {sql.norm('body')} AS t FROM note), l AS (SELECT * FROM b WHERE length(t) >= 80), r AS (SELECT t, min(id) AS rep FROM l GROUP BY t)
      SELECT id, rep AS within FROM l JOIN r USING (t) WHERE id <> rep UNION ALL SELECT a.rep, b.rep FROM r a JOIN r b ON a.rep <> b.rep AND length(a.t) < length(b.t) AND contains(b.t, a.t)""",
    "q33_link_audit": rf"""WITH {_NOTE}, s AS (SELECT *, lower(trim(regexp_extract(path, '([^/]+)\.md$', 1))) AS stem FROM note),
      n AS (SELECT stem AS x FROM s UNION SELECT lower(trim(title)) FROM s UNION SELECT lower(trim(unnest(aliases))) FROM s), c AS (SELECT lower(trim(unnest(tags))) AS x FROM s UNION SELECT lower(trim(unnest(concepts))) FROM s),
      own AS (SELECT id, stem, text FROM s WHERE coalesce(status, '') <> 'archived' AND stem <> 'index'), o AS (SELECT DISTINCT id, lower(trim(t)) AS t FROM (SELECT id, unnest({sql._LINKS}) AS t FROM own))
      SELECT CASE WHEN t IN (SELECT x FROM n WHERE x <> '') THEN 'note' WHEN t IN (SELECT x FROM c) THEN 'concept' ELSE 'unknown' END AS kind, count(*) AS n FROM o GROUP BY 1
      UNION ALL SELECT 'orphan', count(*) FROM own WHERE id NOT IN (SELECT id FROM o) AND stem NOT IN (SELECT t FROM o)""",
    "q45_sentence_split": f"""SELECT coalesce({sql._ROLE}, 'unknown') AS plain_role, count(*) AS n_sentences, count(DISTINCT s) AS n_distinct, sum(length(s))::BIGINT AS n_chars, count(*) FILTER (WHERE regexp_matches(s, '[?？]$')) AS n_questions
      FROM (SELECT role, unnest({_SENTENCES}) AS s FROM messages WHERE content IS NOT NULL) GROUP BY 1""",
    "q47_page_text": f"SELECT tbl, id, {_page()} AS plain FROM (SELECT 'messages' AS tbl, id::VARCHAR AS id, content FROM messages UNION ALL SELECT 'candidates', id, content FROM candidates) WHERE regexp_matches(content, '</?[A-Za-z][^<>]*>')",
    "q61_gold_kept": f"""WITH k AS (SELECT item_id AS item, split AS part, CASE WHEN split = 'dev' THEN 0 ELSE 1 END AS p, kind AS title, {_key()} AS key FROM bench),
      f AS (SELECT *, CASE WHEN key = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY key ORDER BY p, item) > 1 THEN 'duplicate_key' END AS r FROM k)
      SELECT item, part, title, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY part, title, r IS NULL ORDER BY item) > 2 THEN 'title_cap' END, 'kept') AS reason FROM f""",
}
