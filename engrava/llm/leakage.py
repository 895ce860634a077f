"""Evaluation passages inside training text: winnowed fingerprints, joined, then extended to the spans they belong to."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrava.operators import retrieval
from engrava.session import materialise, small

#: An ideograph, or a run of letters and digits of other scripts.
TOKEN = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
#: Markup inside words, dropped before tokens are cut: emphasis marks, link targets, tags, soft hyphens, broken-line hyphens.
MARKUP = re.compile(r"\]\([^()\s]*\)|<[^<>\n]{1,80}>|[*`~­​]+|-\n\s*")

#: k-gram lengths and window widths, for words and for ideographs: every shared span of k + w - 1 tokens shares a fingerprint.
WORDS = (5, 3)
IDEOGRAPHS = (10, 4)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(MARKUP.sub("", text).lower())


def _codes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit code for each token, equal in every process."""
    out = np.empty(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        c = known.get(w)
        if c is None:
            c = 1469598103934665603
            for b in w.encode():
                c = ((c ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
            known[w] = c
        out[i] = c
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the rightmost minimum of each window of ``width`` grams; grams without a value are never chosen."""
    if len(grams) < width:
        views = grams[None, :]
    else:
        views = np.lib.stride_tricks.sliding_window_view(grams, width)
    last = views.shape[1] - 1 - np.argmin(views[:, ::-1], axis=1)
    at = np.unique(np.arange(len(views)) + last)
    return at[grams[at] != _NONE]


def fingerprints(words: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed fingerprints of one token list and their positions, of word k-grams and of ideograph k-grams."""
    codes = _codes(words, known)
    han = np.fromiter((len(w) == 1 and "㐀" <= w <= "鿿" for w in words), dtype=bool, count=len(words))
    fps, at = [], []
    for (k, width), kind in ((WORDS, ~han), (IDEOGRAPHS, han)):
        n = len(codes) - k + 1
        if n <= 0 or not kind.any():
            continue
        sums = np.concatenate([[0], np.cumsum(kind)])
        whole = sums[k:] - sums[:-k] >= (k if k == WORDS[0] else k - 1)
        gram = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            gram = _mix(gram * np.uint64(31) + codes[j : j + n])
        gram[~whole] = _NONE
        keep = _winnow(gram, width)
        fps.append(gram[keep])
        at.append(keep)
    if not fps:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(fps), np.concatenate(at)


def fingerprint_rows(texts: DataFrame, key: str) -> DataFrame:
    """``key``, ``fp``, ``at`` for the winnowed fingerprints of the whole of each ``text``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            if len(known) > 500_000:
                known.clear()
            keys, fps, ats = [], [], []
            for k, text in zip(pdf[key], pdf["text"], strict=True):
                fp, at = fingerprints(tokens(text), known)
                keys.append(np.full(len(fp), k, dtype=np.int64))
                fps.append(fp.view(np.int64))
                ats.append(at.astype(np.int32))
            if keys:
                yield pd.DataFrame({key: np.concatenate(keys), "fp": np.concatenate(fps), "at": np.concatenate(ats)})

    return texts.where(F.col("text").isNotNull()).select(key, "text").mapInPandas(cut, f"{key} bigint, fp bigint, at int")


def covered(doc: list[str], item: list[str], seeds: list[tuple[int, int]], gap: int = 4) -> np.ndarray:
    """Item tokens that the document holds around the seeds (document position, item position).

    From each seed both sides are followed while tokens agree. Where they differ, up to ``gap`` tokens may be changed, left
    out or put in, if at least two tokens agree after that.
    """
    mask = np.zeros(len(item), dtype=bool)
    done: set[tuple[int, int]] = set()
    for d0, i0 in seeds:
        if (d0, i0) in done:
            continue
        for step in (1, -1):
            d, i = (d0, i0) if step == 1 else (d0 - 1, i0 - 1)
            while 0 <= d < len(doc) and 0 <= i < len(item):
                if doc[d] == item[i]:
                    mask[i] = True
                    done.add((d, i))
                    d, i = d + step, i + step
                    continue
                for total in range(1, 2 * gap + 1):
                    jump = next(
                        (
                            (a, total - a)
                            for a in range(max(0, total - gap), min(gap, total) + 1)
                            if all(0 <= d + step * (a + s) < len(doc) and 0 <= i + step * (total - a + s) < len(item) and doc[d + step * (a + s)] == item[i + step * (total - a + s)] for s in (0, 1))
                        ),
                        None,
                    )
                    if jump:
                        break
                if not jump:
                    break
                d, i = d + step * jump[0], i + step * jump[1]
    return mask


def leaks(documents: DataFrame, items: DataFrame, *, share: float = 0.5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Documents that hold at least ``share`` of the tokens of an item's text: ``doc_id``, ``item_id``, ``share``, ``longest``.

    ``documents`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; further columns are not read. Case,
    punctuation, markup, line breaks and the order of pieces do not matter. Winnowing guarantees that every shared span of
    ``k + w - 1`` tokens gives a common fingerprint; hits are extended over small changes. Item fingerprints are broadcast only
    if they are at most ``broadcast_rows``; beyond that the join shuffles on the fingerprint. Items too short for a fingerprint are
    found where their tokens stand whole and in order. Null and empty texts hold nothing;
    repeated documents each count by their own id; an empty side gives an empty result.
    """
    wanted = fingerprint_rows(items, "item_id").select("item_id", "fp", F.col("at").alias("item_at"))
    if wanted.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    hits = fingerprint_rows(documents, "doc_id").join(wanted, "fp")
    pairs = materialise(hits.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_set(F.struct(F.col("at").alias("d"), F.col("item_at").alias("i")))).alias("seeds")), "seeds")
    answers = items.where(F.col("text").isNotNull()).select("item_id", F.col("text").alias("item_text"))
    # only the texts of documents with a hit are shuffled
    there = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(small(pairs.select("doc_id").distinct(), broadcast_rows), "doc_id", "left_semi")
    found = pairs.join(there, "doc_id").join(small(answers, 10_000), "item_id")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                item = tokens(r.item_text)
                mask = covered(tokens(r.text), item, [(int(s["d"]), int(s["i"])) for s in r.seeds])
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                rows.append((r.doc_id, r.item_id, float(mask.mean()) if len(mask) else 0.0, int((edges[1::2] - edges[::2]).max(initial=0))))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "longest"])

    long = found.mapInPandas(extend, "doc_id bigint, item_id bigint, share double, longest int").where(F.col("share") >= share)
    short = spaced_tokens(items, "item_id").where(~F.col("marked")).select("item_id", "part")
    if short.isEmpty():
        return long
    texts = spaced_tokens(documents, "doc_id").select(F.col("doc_id").alias("id"), F.col("part").alias("text"))
    whole = retrieval.containing(texts, short.select("part")).join(small(short), "part")
    return long.unionByName(whole.select(F.col("id").alias("doc_id"), "item_id", F.lit(1.0).alias("share"), (F.size(F.split(F.trim("part"), " "))).alias("longest")))


def spaced_tokens(texts: DataFrame, key: str) -> DataFrame:
    """The tokens of each text that has some, each between spaces (``part``), and whether the text is long enough to be ``marked`` by a fingerprint."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [tokens(t) for t in pdf["text"]]
            yield pd.DataFrame({key: pdf[key], "part": [" " + " ".join(w) + " " if w else "" for w in words], "marked": [len(fingerprints(w, {})[0]) > 0 for w in words]})

    return texts.where(F.col("text").isNotNull()).select(key, "text").mapInPandas(cut, f"{key} bigint, part string, marked boolean").where("part <> ''")
