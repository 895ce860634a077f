"""Search over notes: keyword evidence, identifiers in queries, routes, fusion with a second channel, and notes that belong together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.functions import notes as note
from engrava.functions.text import bigrams, normalised
from engrava.session import materialise, small

# Forms of identifiers in a query, in the order in which they are looked for.
IDENTIFIERS = (
    r"[“\"']([^”\"']{2,120})[”\"']",
    r"(https?://[^\s，。！？；]+)",
    r"(--[A-Za-z0-9][A-Za-z0-9_-]*)",
    r"(?:^|[^A-Za-z0-9_.])([vV]?[0-9]+\.[0-9]+(?:\.[0-9]+)*)",
    r"(?:^|[^A-Za-z0-9_])(0[xX][0-9a-fA-F]{2,}|[eE][0-9]{2,}|[eE][rR][rR](?:[oO][rR])?[-_]?[0-9]{2,}|[hH][tT][tT][pP][-_ ]?[0-9]{3})",
    r"([A-Za-z0-9_.-]+\.(?:md|py|jsonl|json|yaml|yml|toml|ini|log|sql|db|sh|js|ts|csv))",
    r"((?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?)",
    r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)",
    r"(?:^|[^A-Za-z0-9_-])([A-Za-z][A-Za-z_-]*[0-9][A-Za-z0-9_-]*)",
)
# Cues of the query modes, in order of precedence after identifiers.
CUES = {
    "navigational": "知识库 笔记 文档 文件 哪篇 标题 路径 目录 索引 分类 标签 链接".split(),
    "episodic": "我说过 你记得 还记得 我们决定 约定 偏好 我喜欢 我习惯 聊过 对话 会话 上次说 提过 告诉过你 最近 上次 昨天 今天 当时 之前 以前 后来 最新 当前 现在 刚刚 刚才 最后一次 哪次 几天前 历史 改动 变更 最近一次".split() + ["last time", "recent", "yesterday", "previous"],
    "conceptual": "怎么 如何 为什么 原理 区别 差异 优缺点 方案 设计 关系 是什么 怎么做 支持什么 有哪些 是否 能不能 how why difference design architecture".split(),
}


def exact_terms(query: Column, most: int = 12) -> Column:
    """The identifiers of a query, lower case, distinct and in order, the first ``most``."""
    found = F.concat(*[F.regexp_extract_all(query, F.lit(p), 1) for p in IDENTIFIERS])
    plain = F.filter(F.transform(found, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return F.slice(F.array_distinct(plain), 1, most)


def mode(query: Column) -> Column:
    """``exact`` where the query holds an identifier, else ``navigational``, ``episodic`` or ``conceptual`` by its cues, else ``general``; null and blank queries are ``general``."""
    out = F.when(F.size(exact_terms(query)) > 0, "exact")
    for name, cues in CUES.items():
        out = out.when(F.lower(query).rlike("|".join(cues)), name)
    return out.otherwise("general")


def read_notes(documents: DataFrame) -> DataFrame:
    """Notes of ``documents`` (``doc_id``, ``path``, ``text``): ``id``, ``path``, ``section``, ``title``, ``short``, ``body``, ``status``, ``tags``; rows without a text are left out.

    ``short`` is the title with tags, concepts and category, by which a note is told.
    """
    text = F.col("text")
    concepts = note.flow_list(text, "concepts")
    short = F.concat_ws(" ", note.title(text), note.tags(text), concepts, note.field(text, "category"))
    return documents.where("text IS NOT NULL").select(
        F.col("doc_id").alias("id"), "path", F.split_part("path", F.lit("/"), F.lit(1)).alias("section"), note.title(text).alias("title"), short.alias("short"), note.body(text).alias("body"), F.lower(F.trim(note.field(text, "status"))).alias("status"), note.tags(text).alias("tags")
    )


def live(notes: DataFrame) -> DataFrame:
    """Notes that are not archived; a missing status is not."""
    return notes.where(F.coalesce(F.col("status"), F.lit("")) != "archived")


def against(rows: DataFrame, queries: DataFrame, block: int = 500) -> DataFrame:
    """``rows`` with each query of a stated set as ``q`` (``qid``, ``text``, its ``grams`` and exact ``terms``), about ``block`` queries at a time, which go with the plan."""
    asked = queries.select("qid", F.lower(F.trim("text")).alias("text"), bigrams(F.lower(F.trim("text"))).alias("grams"), exact_terms(F.col("text")).alias("terms")).where("length(text) > 0")
    n_blocks, out = max(1, -(-asked.count() // block)), None
    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    for b in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == b).collect()
        structs = [F.struct(F.lit(r.qid).cast("bigint").alias("qid"), F.lit(r.text).alias("text"), texts(r.grams).alias("grams"), texts(r.terms).alias("terms")) for r in part]
        one = rows.select("*", F.explode(F.array(*structs)).alias("q")) if structs else rows.select("*", F.lit(None).cast("struct<qid:bigint,text:string,grams:array<string>,terms:array<string>>").alias("q")).where(F.lit(False))
        out = one if out is None else out.unionByName(one)
    return out


def keyword(queries: DataFrame, notes: DataFrame) -> DataFrame:
    """Keyword evidence of every note that has some for a query: ``qid``, ``id``, ``raw``, ``exact``, ``keyword``.

    ``raw`` is 5 for the whole query in the title, 3 in the short text, 2 in the body, and up to 2 for the share of its character
    pairs in the short text; ``exact`` is the mean over the query's identifiers of 1 (title), 0.95 (short text) or 0.72 (body).
    ``keyword`` is the larger of ``exact`` and ``raw`` / 5, 1 at most. Null and blank queries give no row.
    """
    told = notes.select("id", F.lower("title").alias("title"), F.lower("short").alias("short"), F.lower("body").alias("body"), bigrams(F.lower("short")).alias("pairs"))
    met = against(told, queries)
    whole = lambda c, points: F.when(F.contains(c, F.col("q.text")), points).otherwise(0.0)
    shared = F.when(F.size("q.grams") > 0, F.size(F.array_intersect("q.grams", "pairs")) / F.size("q.grams") * 2.0).otherwise(0.0)
    point = lambda t: F.when(F.contains("title", t), 1.0).when(F.contains("short", t), 0.95).when(F.contains("body", t), 0.72).otherwise(0.0)
    exact = F.when(F.size("q.terms") > 0, F.aggregate("q.terms", F.lit(0.0), lambda total, t: total + point(t)) / F.size("q.terms")).otherwise(0.0)
    scored = met.select(F.col("q.qid").alias("qid"), "id", (whole("title", 5.0) + whole("short", 3.0) + whole("body", 2.0) + shared).alias("raw"), exact.alias("exact"))
    return scored.withColumn("keyword", F.greatest(F.least(F.col("raw") / 5.0, F.lit(1.0)), F.col("exact"))).where("keyword > 0")


def affinity(hits: Column, cap: float = 0.15, saturation: int = 8) -> Column:
    """Rank multiplier of a note that was used ``hits`` times: 1 without use, 1 + ``cap`` at most; a null count is no use."""
    return F.least(F.lit(1.0 + cap), 1.0 + cap * F.log1p(F.coalesce(hits, F.lit(0)).cast("double")) / F.log1p(F.lit(float(saturation))))


def fuse(keywords: DataFrame, semantic: DataFrame | None, weights: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """Linear fusion of the two channels over their union: ``qid``, ``id``, ``keyword``, ``semantic``, ``score``; the weights of the channels that are on add up to 1."""
    if semantic is None:
        return keywords.select("qid", "id", "keyword", F.lit(0.0).alias("semantic"), F.col("keyword").alias("score"))
    both = keywords.select("qid", "id", "keyword").join(semantic.select("qid", "id", F.col("score").alias("semantic")), ["qid", "id"], "full_outer").na.fill(0.0, ["keyword", "semantic"])
    total = sum(weights)
    return both.withColumn("score", (F.col("keyword") * weights[0] + F.col("semantic") * weights[1]) / total)


def admit(fused: DataFrame, min_score: float, min_keyword: float) -> DataFrame:
    """Rows that pass either corridor, with ``via`` (``fused`` or ``keyword``) and ``order``, the better of both scores; a corridor of 0 is closed."""
    via = F.when(F.lit(min_score > 0) & (F.col("score") >= min_score), "fused").when(F.lit(min_keyword > 0) & (F.col("keyword") >= min_keyword), "keyword")
    return fused.withColumns({"via": via, "order": F.greatest("score", "keyword")}).where("via IS NOT NULL")


def related(tagged: DataFrame, k: int = 5, most_tags: int = 12) -> DataFrame:
    """For each note the ``k`` others that share most tags: ``id``, ``other``, ``shared``, ``rank``; ties go to the smaller id.

    ``tagged`` has unique ``id`` and ``tags``. A tag may belong to a third of all notes, so no two notes are paired through it as
    such: for every set of tags that some note has, the ``k + 1`` smallest notes that hold the whole set are enough, as all notes
    of a set share at least so many tags. Each note meets these few for each of its own sets. Tags are trimmed, lower case and
    distinct; a note with more than ``most_tags`` of them raises an error. Null and empty lists have no related notes.
    """
    plain = F.array_sort(F.array_distinct(F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != ""))))
    rows = tagged.select("id", plain.alias("tags")).where("size(tags) > 0")
    rows = rows.select("id", F.when(F.size("tags") <= most_tags, F.col("tags")).otherwise(F.raise_error(F.lit(f"more than {most_tags} tags"))).alias("tags"))
    sets = F.filter(F.aggregate("tags", F.array(F.array().cast("array<string>")), lambda acc, t: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, t)))), lambda s: F.size(s) > 0)
    spread = rows.select("id", F.explode(sets).alias("s")).select("id", F.size("s").alias("n"), F.to_json("s").alias("s"))
    first = spread.withColumn("place", F.row_number().over(Window.partitionBy("s").orderBy("id"))).where(F.col("place") <= k + 1).select("s", F.col("id").alias("other"))
    met = spread.join(first, "s").where("id <> other").groupBy("id", "other").agg(F.max("n").alias("shared"))
    best = Window.partitionBy("id").orderBy(F.desc("shared"), "other")
    return met.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k).select("id", "other", F.col("shared").cast("bigint").alias("shared"), "rank")


#: Lengths of the runs and windows that mark a body: every body of their sum or more has a mark that each text around it has too.
RUN, WINDOW = 24, 40


def contained(notes: DataFrame, shortest: int = 80, waves: int = 4) -> DataFrame:
    """Notes whose normalised body stands in another note's, or equals it: ``id``, ``within``; of equal bodies the smallest id holds the others.

    ``notes`` has unique ``id`` and ``body``; bodies under ``shortest`` characters (64 at least) take no part. Marks are the least
    hashes of sliding windows over runs of characters, so every text around a body has all its marks: a body meets them by an
    equi-join on its rarest mark, and one with a mark of its own meets none. Marks are counted in ``waves``, each written before
    the next begins; only texts of candidates are shuffled.
    """
    rows = notes.select("id", normalised(F.col("body")).alias("text")).where(F.length("text") >= max(shortest, RUN + WINDOW))
    hashed = rows.select("id", F.unhex(F.md5("text")).alias("h"))
    copied = hashed.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("h", "rep")
    equal = materialise(hashed.join(copied, "h").where("id <> rep").select("id", F.col("rep").alias("within")), "equal")
    texts = rows.join(small(equal.select("id")), "id", "left_anti")
    marks = materialise(texts.mapInPandas(_marks, "id bigint, mark bigint"), "marks")
    met = materialise(_within(marks, waves), "met")
    told = texts.join(small(met.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id", "left_semi")
    both = met.join(told.toDF("a", "ta"), "a").join(told.toDF("b", "tb"), "b")
    return equal.unionByName(both.where(F.contains("tb", "ta")).select(F.col("a").alias("id"), F.col("b").alias("within")))


def _within(marks: DataFrame, waves: int) -> DataFrame:
    """Pairs (``a``, ``b``) where ``b`` has the rarest of the marks of ``a``."""
    least = None
    for wave in range(waves):
        # one shuffle serves the counts and the rows they go to
        own = marks.where(F.pmod(F.xxhash64("mark"), F.lit(waves)) == wave).repartition("mark")
        counted = own.join(own.groupBy("mark").agg(F.count("*").alias("n")), "mark")
        one = materialise(counted.groupBy("id").agg(F.min(F.struct("n", "mark")).alias("rarest")), "rarest")
        least = one if least is None else least.unionByName(one)
    rarest = least.groupBy("id").agg(F.min("rarest").alias("rarest")).where("rarest.n > 1").select(F.col("id").alias("a"), F.col("rarest.mark").alias("mark"))
    return marks.withColumnRenamed("id", "b").join(small(materialise(rarest, "rarest")), "mark").where("a <> b").select("a", "b")


def _marks_of(text: str) -> np.ndarray:
    units = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    run = np.zeros(len(units) - RUN + 1, dtype=np.uint64)
    for j in range(RUN):
        run = run * np.uint64(0x9E3779B97F4A7C15) + units[j : j + len(run)] + np.uint64(1)
    run = (run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return pd.unique(np.lib.stride_tricks.sliding_window_view(run, WINDOW).min(axis=1)).view(np.int64)


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        marks = [_marks_of(text) for text in pdf["text"]]
        if marks:
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), [len(m) for m in marks]), "mark": np.concatenate(marks)})


def link_audit(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Links of live notes by what they point at (``note``, ``concept``, ``unknown``) and live notes that neither link nor are linked (``orphan``): ``kind``, ``n``.

    ``notes`` has ``id``, ``stem``, ``title``, ``aliases``, ``concepts`` and ``status``, ``links`` distinct ``id`` and ``target``. Names are compared without
    case; a concept's name is no note's.
    """
    low = lambda c: F.lower(F.trim(c))
    names = notes.select(F.explode(F.concat(F.array(low(F.col("stem")), low(F.coalesce("title", "stem"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), low))).alias("target")).where("target <> ''").distinct()
    concepts = notes.select(F.explode("concepts").alias("c")).select(low(F.col("c")).alias("target")).distinct()
    own = live(notes).where("stem <> 'index'").select("id", low(F.col("stem")).alias("stem"))
    out = links.join(own.select("id"), "id").select("id", low(F.col("target")).alias("target")).distinct()
    told = out.join(names.withColumn("a", F.lit(True)), "target", "left").join(concepts.withColumn("b", F.lit(True)), "target", "left")
    kinds = told.groupBy(F.when(F.col("a"), "note").when(F.col("b"), "concept").otherwise("unknown").alias("kind")).agg(F.count("*").alias("n"))
    alone = own.join(out.select("id").distinct(), "id", "left_anti").join(out.select(F.col("target").alias("stem")).distinct(), "stem", "left_anti")
    return kinds.unionByName(alone.agg(F.lit("orphan").alias("kind"), F.count("*").alias("n")))


def gold_kept(entries: DataFrame, per_title: int = 2) -> DataFrame:
    """Evaluation entries (``item``, ``part``, ``priority``, ``query``, ``title``) with why they are dropped: ``empty``, ``duplicate_key`` (an entry of an earlier part or item asks the same) or ``title_cap``.

    Entries ask the same if nothing is different but identifiers, dates, words of time, case, punctuation and space. The cap of a
    title holds in its part and counts only entries that were not dropped before.
    """
    keyed = entries.withColumn("key", question_key(F.col("query")))
    same = F.row_number().over(Window.partitionBy("key").orderBy("priority", "item"))
    first = keyed.withColumn("reason", F.when(F.length("key") == 0, "empty").when(same > 1, "duplicate_key"))
    nth = F.row_number().over(Window.partitionBy("part", "title", F.col("reason").isNull()).orderBy("item"))
    capped = F.col("reason").isNull() & F.col("title").isNotNull() & (nth > per_title)
    return first.select("item", "part", "title", F.coalesce("reason", F.when(capped, "title_cap"), F.lit("kept")).alias("reason"))


# What questions may differ in and still ask the same.
VARIABLE = (
    r"https?://\S+",
    r"[\w.+-]+@[\w-]+\.[\w.]+",
    r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    r"/(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+",
    r"\bv?\d+\.\d+(?:\.\d+)+(?:[-_][\w.]+)?",
    r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?",
    r"\d{1,2}:\d{2}(?::\d{2})?",
    "今天|明天|昨天|前天|后天|今日|昨日|明日|现在|目前|最近|刚才|今晚|今早|上午|下午|晚上|早上|本周|上周|下周|今年|去年|明年",
)


def question_key(query: Column) -> Column:
    """What a question asks, without what may vary; full-width letters and digits count as plain ones."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    out = F.lower(F.translate(F.coalesce(query, F.lit("")), wide, "".join(chr(ord(c) - 0xFEE0) for c in wide)))
    for pattern in VARIABLE:
        out = F.regexp_replace(out, pattern, " ")
    return F.regexp_replace(out, r"[^\p{L}\p{N}_]+", "")


def evicted(facts: DataFrame, used: DataFrame, cap: int) -> DataFrame:
    """Facts to give up so that every agent keeps ``cap``, the least used first: by last use (never used counts as 0), then time text, then id.

    ``facts`` has ``fact_id``, ``agent``, ``timestamp``, ``used`` ``key`` and ``last_used``. Without any use nothing is given up: age
    alone is no reason. The kept are found by a limited rank, the rest leave, so one agent may own a third of all facts.
    """
    owned = facts.select("fact_id", F.coalesce("agent", F.lit("")).alias("agent"), F.coalesce("timestamp", F.lit("")).alias("timestamp"))
    told = owned.join(used.select(F.col("key").alias("fact_id"), "last_used"), "fact_id", "left").withColumn("last_used", F.coalesce("last_used", F.lit(0)))
    order = Window.partitionBy("agent").orderBy(F.desc("last_used"), F.desc("timestamp"), F.desc("fact_id"))
    kept = told.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select("fact_id")
    some_use = small(used.limit(1).select(F.lit(True).alias("some")))
    return told.join(kept, "fact_id", "left_anti").crossJoin(some_use).select("fact_id", "agent", "last_used")
