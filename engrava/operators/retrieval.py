"""Scoring, ranking and fusion of retrieval channels over batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.functions.text import normalised, occurrences
from engrava.session import is_small, materialise, small

# Function words that are no query terms.
STOP_TERMS = ("a", "an", "and", "are", "as", "at", "be", "by", "das", "der", "die", "do", "does", "for", "from", "im", "in", "is", "it", "of", "on", "or", "steht", "the", "to", "was", "what", "with", "zu")


def tokens(c: Column) -> Column:
    """Terms in order, repeats kept: lower-case words of two or more letters and digits of any script, and pairs of neighbouring ideographs."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(c), r"[\x{4E00}-\x{9FFF}]+", " "), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    runs = F.regexp_extract_all(c, F.lit(r"([\x{4E00}-\x{9FFF}]{2,})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(words, pairs)


def terms(c: Column) -> Column:
    """Distinct ``tokens`` without function words."""
    return F.array_except(F.array_distinct(tokens(c)), F.array(*[F.lit(w) for w in STOP_TERMS]))


def phrases(c: Column) -> Column:
    """Distinct runs of letters, digits and ideographs, lower case, without function words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1)), F.array(*[F.lit(w) for w in STOP_TERMS]))


def cosine_score(cosine: Column) -> Column:
    """Cosine as a score: 1 - distance / 2 within 0 and 1; a missing or non-finite cosine scores 0.5."""
    c = F.when(cosine.isNull() | F.isnan(cosine), F.lit(0.0)).otherwise(cosine)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (1 - c) / 2))


def _unit(column) -> np.ndarray:
    x = np.stack([np.asarray(r, dtype=np.float64) for r in column])
    return x / np.linalg.norm(x, axis=1)[:, None]


def vector_topk(queries: DataFrame, rows: DataFrame, k: int, block: int = 20_000) -> DataFrame:
    """The ``k`` best rows for each query vector by exact cosine: ``qid``, ``id``, ``score``, ``rank``; ties to the smaller id.

    ``queries`` has ``qid``, ``vector``, ``rows`` has ``id``, ``vector`` (all usable, one width); further columns are not read. A
    row is no hit of the query with its own id. The queries are a stated set; about ``block`` of them at a time are sent to the
    tasks, each of which scans its rows where they lie and keeps ``k`` for each query, so only the best are shuffled.
    An empty side gives an empty result.
    """
    spark = rows.sparkSession
    n_blocks = -(-queries.count() // block)
    met = None
    for b in range(n_blocks):
        asked = queries.where(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == b).select("qid", "vector").toPandas()
        if asked.empty:
            continue
        shared = spark.sparkContext.broadcast((asked["qid"].to_numpy(dtype=np.int64), _unit(asked["vector"])))
        one = rows.select("id", "vector").mapInPandas(_best_of(shared, k), "qid bigint, id bigint, cosine double")
        met = one if met is None else met.unionByName(one)
    if met is None:
        met = spark.createDataFrame([], "qid bigint, id bigint, cosine double")
    best = Window.partitionBy("qid").orderBy(F.desc("cosine"), "id")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("qid", "id", cosine_score(F.col("cosine")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _best_of(shared, k: int):
    """A task's ``k`` best rows for each query of the block, kept over its batches."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q = shared.value
        at, ids, cosines = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        bar = np.full(len(qid), -np.inf)  # the cosine a row must reach to be among the best
        for pdf in batches:
            for a in range(0, len(pdf), 1000):
                own, x = pdf["id"].to_numpy(dtype=np.int64)[a : a + 1000], _unit(pdf["vector"].iloc[a : a + 1000])
                for c in range(0, len(qid), 2000):
                    cos = np.round(q[c : c + 2000] @ x.T, 6)
                    i, j = np.nonzero(cos >= bar[c : c + 2000, None])
                    i, j = i[qid[c + i] != own[j]], j[qid[c + i] != own[j]]
                    at, ids, cosines = np.concatenate([at, c + i]), np.concatenate([ids, own[j]]), np.concatenate([cosines, cos[i, j]])
                order = np.lexsort((ids, -cosines, at))
                at, ids, cosines = at[order], ids[order], cosines[order]
                nth = np.arange(len(at)) - np.searchsorted(at, at)
                bar[at[nth == k - 1]] = cosines[nth == k - 1]
                at, ids, cosines = at[nth < k], ids[nth < k], cosines[nth < k]
        yield pd.DataFrame({"qid": qid[at], "id": ids, "cosine": cosines})

    return scan


def matches(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """How often each asked term occurs in each text: ``id``, ``len`` (all tokens of the text), ``term``, ``tf``; and one row of every text under the empty term.

    ``asked`` has distinct ``term``. The terms meet a text's own distinct terms before anything is shuffled, and ``tf`` is counted in
    the row; only terms beyond the checked size of a broadcast are joined by a shuffle. Written once: scores, document
    frequencies and lengths read the same table.
    """
    wanted = asked.select("term").distinct().unionByName(asked.sparkSession.createDataFrame([("",)], "term string"))
    cut = texts.select("id", tokens(F.col("text")).alias("w")).where("w IS NOT NULL")
    cut = cut.select("id", "w", F.size("w").alias("len"), F.explode(F.array_append(F.array_distinct("w"), F.lit(""))).alias("term"))
    if is_small(wanted):
        met = cut.join(F.broadcast(wanted), "term").withColumn("tf", F.col("len") - F.size(F.array_remove("w", F.col("term"))))
    else:
        met = cut.withColumn("tf", F.col("len") - F.size(F.array_remove("w", F.col("term")))).drop("w").join(wanted, "term")
    return materialise(met.select("id", F.col("len").cast("bigint").alias("len"), "term", F.col("tf").cast("bigint").alias("tf")), "matches")


def bm25(queries: DataFrame, texts: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of every text that shares a term with a query: ``qid``, ``id``, ``bm25``.

    Null and empty texts and queries without terms give no row; further columns are not read; ``id`` and ``qid`` must be unique.

    Only terms of the queries are looked up (``matches``); statistics are over all texts that are not null. A term in more than
    half of the texts keeps a tiny weight.
    """
    asked = queries.select("qid", F.explode(terms(F.col("text"))).alias("term")).distinct()
    found = matches(asked, texts)
    hits = found.where("term <> ''")
    stats = found.where("term = ''").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    # one row for each asked term
    weights = small(hits.groupBy("term").agg(F.count("*").alias("df")))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    weighted = hits.join(weights, "term").crossJoin(F.broadcast(stats))
    scored = weighted.select("id", "term", part.alias("part")).join(small(asked), "term").groupBy("qid", "id").agg(F.sum("part").alias("bm25"))
    return materialise(scored, "bm25")


def min_max(scored: DataFrame, score: str) -> DataFrame:
    """Scores scaled within each query: best 1, worst 0; 0.8 where all are equal."""
    ends = scored.groupBy("qid").agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), 0.8).otherwise((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return scored.join(small(ends), "qid").withColumn("scaled", scaled).drop("lo", "hi")


def decay(age_seconds: Column, half_life_hours: float = 168.0) -> Column:
    """exp(-0.693 age / half life); 1 for a missing time, never above 1 for times to come."""
    return F.when(age_seconds.isNull(), 1.0).otherwise(F.exp(-0.693 * F.greatest(F.lit(0.0), age_seconds) / (half_life_hours * 3600)))


def rate(matched: Column, total: Column) -> Column:
    """matched / total with a denominator that stops growing at three; 0 without terms."""
    return F.when(total > 0, F.least(F.lit(1.0), matched / F.greatest(F.lit(1), F.least(total, F.lit(3))))).otherwise(0.0)


def term_coverage(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Lexical rate of each text with a common term: ``qid``, ``id``, ``matched``, ``rate`` = min(1, matched / max(1, min(terms, 3)))."""
    asked = queries.select("qid", terms(F.col("text")).alias("ts")).select("qid", F.size("ts").alias("n_terms"), F.explode("ts").alias("term"))
    there = texts.select("id", F.explode(terms(F.col("text"))).alias("term"))
    matched = there.join(small(asked), "term").groupBy("qid", "id", "n_terms").agg(F.count("*").alias("matched"))
    return matched.select("qid", "id", "matched", rate(F.col("matched"), F.col("n_terms")).alias("rate"))


def phrase_coverage(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Rate of each query's phrases that stand in a text as substrings, whatever their case: ``qid``, ``id``, ``phrases``, ``rate``."""
    asked = queries.select("qid", phrases(F.col("text")).alias("ps")).select("qid", F.size("ps").alias("n"), F.explode("ps").alias("part"))
    met = containing(texts.select("id", F.lower("text").alias("text")), asked.select("part"))
    counted = met.join(small(asked), "part").groupBy("qid", "id", "n").agg(F.count("*").alias("phrases"))
    return counted.select("qid", "id", "phrases", rate(F.col("phrases"), F.col("n")).alias("rate"))


def containing(texts: DataFrame, wanted: DataFrame, most: int = 100_000) -> DataFrame:
    """Which of the distinct, not empty ``part`` of ``wanted`` stand in which text: ``id``, ``part``, ``times`` (without overlap).

    Up to ``most`` parts are sent to the tasks, which search each text once for all of them by an Aho-Corasick automaton. More
    parts meet the texts by an equi-join of their first one to three characters with the runs of characters of the texts.
    """
    texts, wanted = texts.select("id", "text").where("text IS NOT NULL"), wanted.select("part").where("length(part) > 0").distinct()
    times = occurrences(F.col("text"), F.col("part"))
    if is_small(wanted, most):
        shared = texts.sparkSession.sparkContext.broadcast([r.part for r in wanted.collect()])
        return texts.mapInPandas(_search(shared), "id bigint, part string, times bigint")
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - (n - 1), F.lit(1))), lambda i: F.substring("text", i, F.lit(n)))
    spread = texts.select("id", "text", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("head"))
    return spread.join(wanted.withColumn("head", F.substring("part", 1, 3)), "head").where(F.contains("text", "part")).select("id", "part", times.alias("times")).distinct()


def _search(shared):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for part in shared.value:
            found.add_word(part, part)
        found.make_automaton()
        for pdf in batches:
            rows: list[tuple[int, str, int]] = []
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                last: dict[str, int] = {}
                times: dict[str, int] = {}
                for end, part in found.iter(text) if len(found) else ():
                    if end - len(part) >= last.get(part, -1):
                        times[part], last[part] = times.get(part, 0) + 1, end
                rows += [(key, part, n) for part, n in times.items()]
            yield pd.DataFrame(rows, columns=["id", "part", "times"])

    return scan


# The terms that tell a text, in lower-case normalised text.
DISTINCTIVE = r"[a-z0-9][a-z0-9_.-]{1,}|[\x{4E00}-\x{9FFF}]{2,}"


def covering(texts: DataFrame, wanted: DataFrame, block: int = 10_000) -> DataFrame:
    """Which texts hold which wanted text: the whole of it, or at least half of its distinctive terms, repeats counted: ``qid``, ``id``.

    ``wanted`` (``qid``, ``text``) is a stated set, sent to the tasks about ``block`` rows at a time; each text is searched once for
    all terms of the block. Both sides are normalised and read whole; null and empty texts hold nothing and are held by none.
    """
    spark = texts.sparkSession
    cut = wanted.select("qid", normalised(F.col("text")).alias("whole")).where("length(whole) > 0").withColumn("terms", F.regexp_extract_all("whole", F.lit(f"({DISTINCTIVE})"), 1))
    hay = texts.select("id", normalised(F.col("text")).alias("text")).where("length(text) > 0")
    n_blocks, out = -(-cut.count() // block), None
    for b in range(n_blocks):
        rows = cut.where(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == b).collect()
        shared = spark.sparkContext.broadcast([(r.qid, r.whole, list(r.terms)) for r in rows])
        one = hay.mapInPandas(_cover(shared), "qid bigint, id bigint")
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "qid bigint, id bigint") if out is None else out


def _cover(shared):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        wanted = shared.value
        found, weights = ahocorasick.Automaton(), {}
        for nth, (_, whole, parts) in enumerate(wanted):
            weights.setdefault(whole, ([], []))[1].append(nth)
            for part in parts:
                weights.setdefault(part, ([], []))[0].append(nth)
        terms = list(weights)
        for at, term in enumerate(terms):
            found.add_word(term, at)
        if terms:
            found.make_automaton()
        of_term = [np.array(weights[t][0], dtype=np.int64) for t in terms]
        of_whole = [np.array(weights[t][1], dtype=np.int64) for t in terms]
        need = np.array([len(parts) / 2 if parts else np.inf for _, _, parts in wanted])
        keys = np.array([key for key, _, _ in wanted], dtype=np.int64)
        for pdf in batches:
            qid, ids = [], []
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                here = {at for _, at in found.iter(text)} if terms else ()
                n, full = np.zeros(len(wanted)), np.zeros(len(wanted), dtype=bool)
                for at in here:
                    np.add.at(n, of_term[at], 1)
                    full[of_whole[at]] = True
                held = keys[(n >= need) | full]
                qid.append(held)
                ids.append(np.full(len(held), key, dtype=np.int64))
            if qid:
                yield pd.DataFrame({"qid": np.concatenate(qid), "id": np.concatenate(ids)}).drop_duplicates()

    return scan


def lexical(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """The better of term rate and phrase rate of each text that has one: ``qid``, ``id``, ``score`` in 0 to 1."""
    both = term_coverage(queries, texts).select("qid", "id", "rate").unionByName(phrase_coverage(queries, texts).select("qid", "id", "rate"))
    return both.groupBy("qid", "id").agg(F.max("rate").alias("score")).where("score > 0")


def rescue(hits: DataFrame, lexical_hits: DataFrame, budget: int, full: float = 1.0) -> DataFrame:
    """Ranked ``hits`` (``qid``, ``id``, ``rank``) with lexical rows of full coverage that they lack appended behind them, up to ``budget`` rows of a query: ``qid``, ``id``, ``rank``, ``rescued``."""
    lacking = lexical_hits.where(F.col("score") >= full).join(hits.select("qid", "id"), ["qid", "id"], "left_anti")
    extra = lacking.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("nth") <= budget)
    held = hits.groupBy("qid").agg(F.max("rank").alias("last"))
    placed = extra.join(held, "qid", "left").select("qid", "id", (F.coalesce("last", F.lit(0)) + F.col("nth")).cast("bigint").alias("rank"), F.lit(True).alias("rescued"))
    return hits.select("qid", "id", F.col("rank").cast("bigint").alias("rank"), F.lit(False).alias("rescued")).unionByName(placed).where(F.col("rank") <= budget)


def top(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The ``k`` best of each query with their ``rank``; ties to the smaller id. Spark limits each partition before the shuffle."""
    best = Window.partitionBy("qid").orderBy(F.desc(score), "id")
    return scored.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)


def rank_fusion(channels: dict[str, tuple[DataFrame, float]], constant: int = 60, fixed: bool = False) -> DataFrame:
    """Reciprocal-rank fusion of ranked channels (``qid``, ``id``, ``rank``): ``qid``, ``id``, ``fused`` and the ``n_channels`` that had it.

    The sum of weight / (constant + rank) over the channels, divided by its largest possible value: over the channels the query
    has, or with ``fixed`` over all channels (one channel alone then cannot exceed its weight). One union and one aggregation.
    """
    rows = None
    for name, (df, weight) in channels.items():
        one = df.select("qid", "id", "rank", F.lit(weight).alias("weight"), F.lit(name).alias("channel"))
        rows = one if rows is None else rows.unionByName(one)
    fused = rows.groupBy("qid", "id").agg(F.sum(F.col("weight") / (constant + F.col("rank"))).alias("total"), F.count("*").alias("n_channels"))
    if fixed:
        most = F.lit(sum(w for _, w in channels.values()) / (constant + 1))
        return fused.select("qid", "id", F.least(F.lit(1.0), F.col("total") / most).alias("fused"), "n_channels")
    present = rows.select("qid", "channel", "weight").distinct().groupBy("qid").agg((F.sum("weight") / (constant + 1)).alias("most"))
    return fused.join(present, "qid").select("qid", "id", F.least(F.lit(1.0), F.col("total") / F.col("most")).alias("fused"), "n_channels")


def session_cap(scored: DataFrame, score: str, cap: int, limit: int) -> DataFrame:
    """At most ``cap`` rows of a session for each query, then the ``limit`` best; rows without a session are not capped."""
    own = Window.partitionBy("qid", "session").orderBy(F.desc(score), "id")
    capped = scored.withColumn("in_session", F.row_number().over(own)).where(F.col("session").isNull() | (F.col("in_session") <= cap)).drop("in_session")
    return top(capped, score, limit)


def pack(ranked: DataFrame, budget: int, per_token: int = 4) -> DataFrame:
    """Greedy packing of each query's ranked texts (``qid``, ``id``, ``rank``, ``n_chars``): a row that does not fit is passed over, later ones may fit.

    Ranked lists are short (a top-k), so a query's list is folded in order as one array.
    """
    cost = F.ceil(F.col("n_chars") / per_token)
    rows = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", cost.alias("cost")))).alias("rows"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    step = lambda acc, x: F.when(acc.used + x.cost <= budget, F.struct((acc.used + x.cost).alias("used"), F.array_append(acc.ids, x.id).alias("ids"))).otherwise(acc)
    return rows.select("qid", F.aggregate("rows", start, step).alias("p")).select("qid", F.posexplode("p.ids").alias("position", "id"), F.col("p.used").alias("used"))


def diversity_pool(k: int) -> int:
    """How many of the best candidates ``diverse`` chooses ``k`` from."""
    return min(max(5 * k, 20), 60)


def diverse(ranked: DataFrame, k: int, weight: float) -> DataFrame:
    """Maximal marginal relevance over each query's pool, its ``diversity_pool(k)`` best (``qid``, ``id``, ``score``, ``text``; pools are top-k lists): ``qid``, ``id``, ``position``."""
    most = diversity_pool(k)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).head(most)
        grams = [{t[i : i + 2] for i in range(len(t) - 1)} for t in pdf["text"].fillna("").str.lower()]
        score, left, taken = pdf["score"].to_numpy(), list(range(len(pdf))), []
        near = np.zeros(len(pdf))
        while left and len(taken) < k:
            best = max(left, key=lambda i: (weight * score[i] - (1 - weight) * near[i], -i))
            left.remove(best)
            taken.append(best)
            for i in left:
                union = len(grams[i] | grams[best])
                near[i] = max(near[i], len(grams[i] & grams[best]) / union if union else 0.0)
        return pd.DataFrame({"qid": pdf["qid"].iloc[taken], "id": pdf["id"].iloc[taken], "position": range(len(taken))})

    return ranked.select("qid", "id", "score", "text").groupBy("qid").applyInPandas(choose, "qid bigint, id bigint, position bigint")
