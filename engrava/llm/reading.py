"""Reading level of every document, spread over the document-word graph from a few graded documents."""

from __future__ import annotations

import logging
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrava.session import materialise

_LOG = logging.getLogger(__name__)

#: Word nodes: words share this many buckets, so a table of node scores has a fixed size whatever the vocabulary.
NODES = 1 << 17
_UNIT = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+")
_SENTENCE = re.compile(r"[.!?。！？\n]+")


def _code(word: str) -> int:
    return zlib.crc32(word.encode()) % NODES


def nodes_of(text: str, known: dict[str, int]) -> np.ndarray:
    """The distinct word nodes of a text, and nodes for its sentence length, word length and share of long words.

    Words are lower-case; Chinese counts by pairs of ideographs. The measures are cut to steps and kept apart by script.
    """
    units = _UNIT.findall(text.lower())
    if not units:
        return np.empty(0, np.int32)
    han = [len(u) == 1 and "㐀" <= u <= "鿿" for u in units]
    script = "h" if sum(han) * 2 > len(units) else "l"
    words = [a + b if ha and hb else b for a, b, ha, hb in zip(["", *units[:-1]], units, [False, *han[:-1]], han, strict=True)]
    sentences = max(1, sum(1 for s in _SENTENCE.split(text) if len(s) > 3))
    mean = sum(map(len, units)) / len(units)
    long = sum(len(u) > 8 for u in units) / len(units)
    shape = [f"#{script}s{round(len(units) / sentences / (6 if script == 'h' else 3))}", f"#{script}w{round(mean * 2)}", f"#{script}l{round(long * 20)}"]
    found = set()
    for w in [*words, *shape]:
        c = known.get(w)
        if c is None:
            c = known[w] = _code(w)
        found.add(c)
    return np.fromiter(found, dtype=np.int32, count=len(found))


def _graph(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the mean of its labels (null where ungraded) and its word nodes."""
    graded = labels.where("level IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("level").cast("double")).alias("label"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            if len(known) > 500_000:
                known.clear()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "nodes": [nodes_of(t or "", known) for t in pdf["text"]]})

    return documents.select("doc_id", "text").join(graded, "doc_id", "left").mapInPandas(cut, "doc_id bigint, label double, nodes array<int>")


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a block: (document number, node)."""
    sizes = np.array([len(n) for n in pdf["nodes"]], dtype=np.int64)
    edges = np.concatenate(pdf["nodes"].tolist()) if sizes.sum() else np.empty(0, np.int32)
    return np.repeat(np.arange(len(pdf)), sizes), edges.astype(np.int64)


def _estimate(pdf: pd.DataFrame, score: np.ndarray, weight: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted means of node scores for a block of documents, with the edges."""
    owner, node = _flat(pdf)
    w = weight[node]
    top = np.bincount(owner, weights=w * score[node], minlength=len(pdf))
    down = np.bincount(owner, weights=w, minlength=len(pdf))
    return np.where(down > 0, top / np.maximum(down, 1e-12), prior), owner, node


def levels(documents: DataFrame, labels: DataFrame, *, rounds: int = 30, tolerance: float = 0.002) -> DataFrame:
    """An estimate for every document: ``doc_id``, ``level`` (1 plain to 5 demanding, in the labels' range).

    The graph joins documents and word nodes. Graded documents are clamped to the mean of their labels; in each round every node
    takes the weighted mean of its documents and every other document that of its nodes, until the scores move less than
    ``tolerance`` on average: the harmonic solution; a warning tells if ``rounds`` end before. Rare nodes weigh more to a document.
    To a node its graded documents, with one more clamped to the mean of all labels, weigh as much together as its ungraded ones,
    or few labels would drown. A node's sums are made in each partition before the shuffle; only the table of ``NODES`` scores
    reaches the driver. In the end the raw means, which propagation draws together, are mapped to levels by the line that fits
    the graded documents, each estimated from its nodes without its own part in them.

    Null or empty texts and graphs without any label take the mean label (3 where there is none); null levels and labels of
    unknown documents are ignored; several labels of a document are averaged. ``doc_id`` must be unique.
    """
    graph = materialise(_graph(documents, labels), "graph")
    spark = graph.sparkSession
    told = graph.agg(F.avg("label").alias("prior"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).first()
    prior = told.prior if told.prior is not None else 3.0

    def pass_over(score: np.ndarray | None, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of document levels by node; without scores, of the graded documents, with the numbers of all and of graded documents."""
        shared = spark.sparkContext.broadcast((score, weight))

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s, w = shared.value
            total, count, graded_count = np.zeros(NODES), np.zeros(NODES), np.zeros(NODES)
            for pdf in batches:
                label = pdf["label"].to_numpy(dtype=float)
                if s is None:
                    owner, node = _flat(pdf)
                    graded = ~np.isnan(label[owner])
                    total += np.bincount(node[graded], weights=label[owner[graded]] - prior, minlength=NODES)
                    count += np.bincount(node, minlength=NODES)
                    graded_count += np.bincount(node[graded], minlength=NODES)
                    continue
                value, owner, node = _estimate(pdf, s, w, prior)
                value = np.where(np.isnan(label), value, 0.0)  # the graded ones are summed once, before
                total += np.bincount(node, weights=value[owner], minlength=NODES)
            at = np.flatnonzero((total != 0) | (count != 0))
            yield pd.DataFrame({"node": at.astype(np.int32), "total": total[at], "count": count[at], "graded": graded_count[at]})

        sums = graph.select("label", "nodes").mapInPandas(add, "node int, total double, count double, graded double").groupBy("node")
        sums = sums.agg(F.sum("total").alias("total"), F.sum("count").alias("count"), F.sum("graded").alias("graded")).toPandas()
        out = [np.zeros(NODES) for _ in range(3)]
        for values, name in zip(out, ("total", "count", "graded"), strict=True):
            values[sums["node"].to_numpy()] = sums[name].to_numpy()
        shared.unpersist()
        return tuple(out)

    total, degree, graded = pass_over(None, None)
    clamped, ungraded = prior + total / (graded + 1.0), degree - graded
    # the first scores; the rounds forget them
    score = prior + total / (graded + 2.0)
    # a node of one document only returns that document's own level and says nothing about others; ungraded nodes tell less
    weight = np.where(degree > 1, np.log1p(told.n / np.maximum(1.0, degree)), 0.0) * (0.2 + (graded > 0))
    moved, done = np.inf, 0
    while moved >= tolerance and done < rounds:
        others = np.where(ungraded > 0, pass_over(score, weight)[0] / np.maximum(ungraded, 1.0), clamped)
        new = np.where(graded > 0, 0.5 * clamped + 0.5 * others, np.where(ungraded > 0, others, score))
        moved = float(np.abs(new - score)[degree > 1].mean()) if (degree > 1).any() else 0.0
        score, done = new, done + 1
    if moved >= tolerance:
        _LOG.warning("reading levels still move by %.4f after %d rounds", moved, rounds)
    shared = spark.sparkContext.broadcast((score, weight, clamped, graded))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, w, c, g = shared.value
        for pdf in batches:
            value, owner, node = _estimate(pdf, s, w, prior)
            label = pdf["label"].to_numpy(dtype=float)
            # a graded document's nodes without its clamp
            own, n = label[owner] - prior, g[node]
            rest = np.where(n > 1, s[node] - 0.5 * c[node] + 0.5 * (prior + ((c[node] - prior) * (n + 1) - own) / np.maximum(n, 1.0)), 2 * s[node] - c[node])
            less = np.where(n > 1, w[node], w[node] / 6)  # it would be an ungraded node
            top, down = np.bincount(owner, weights=np.nan_to_num(less * rest), minlength=len(pdf)), np.bincount(owner, weights=less, minlength=len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "raw": np.where(np.isnan(label), value, np.where(down > 0, top / np.maximum(down, 1e-12), prior))})

    raw = graph.mapInPandas(place, "doc_id bigint, label double, raw double")
    fit = raw.where("label IS NOT NULL").agg(F.regr_slope("label", "raw").alias("slope"), F.regr_intercept("label", "raw").alias("cut")).first()
    slope, cut = (fit.slope, fit.cut) if fit.slope is not None and np.isfinite(fit.slope) and fit.slope > 0 else (1.0, 0.0)
    low, high = (told.low, told.high) if told.low is not None else (1.0, 5.0)
    return raw.select("doc_id", F.greatest(F.lit(low), F.least(F.lit(high), F.lit(slope) * F.col("raw") + F.lit(cut))).alias("level"))


def profile(documents: DataFrame, level: DataFrame) -> DataFrame:
    """By source and plain language: documents, mean level, and how many are demanding (4 or more)."""
    plain = F.lower(F.regexp_extract(F.coalesce("lang", F.lit("")), r"^([A-Za-z]{2,3})", 1))
    return documents.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.when(plain.isin("", "und"), "unknown").otherwise(plain).alias("lang")).join(level, "doc_id").groupBy("source", "lang").agg(
        F.count("*").alias("n_documents"), F.avg("level").alias("mean_level"), F.count_if(F.col("level") >= 4).alias("n_demanding")
    )
