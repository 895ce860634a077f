"""Near-duplicate texts: consistent samples of shingles (weighted by TF-IDF, or of the plain sets), banded, then verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrava.functions.text import normalised
from engrava.session import materialise, shuffle_partitions, small

#: Document frequencies are kept in this many buckets by shingle hash: a table of fixed size, whatever the corpus.
BUCKETS = 1 << 18
_LOW = np.uint64((1 << 43) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], kind: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text number, 43-bit shingle hash, times in the text), sorted by text. At most 2^21 texts."""
    if kind == "chars":
        units = [np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32) for t in texts]
    else:
        known: dict[str, int] = {}
        units = [np.array([known.setdefault(w, _word_code(w)) for w in t.split()], dtype=np.uint64) for t in texts]
    lengths = np.array([len(u) for u in units], dtype=np.int64)
    flat = np.concatenate(units).astype(np.uint64) if units else np.empty(0, np.uint64)
    if len(flat) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    gram = np.zeros(len(flat) - size + 1, dtype=np.uint64)
    for j in range(size):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + flat[j : j + len(gram)] + np.uint64(1)
    owner = np.repeat(np.arange(len(texts)), lengths)
    whole = owner[: len(gram)] == owner[size - 1 :]
    key = (owner[: len(gram)][whole].astype(np.uint64) << np.uint64(43)) | (_mix(gram[whole]) & _LOW)
    key, tf = np.unique(key, return_counts=True)
    return (key >> np.uint64(43)).astype(np.int64), key & _LOW, tf


def _word_code(word: str) -> int:
    c = 1469598103934665603
    for b in word.encode():
        c = ((c ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return c


def _weights(hashes: np.ndarray, tf: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log(tf)) * np.log1p(n / np.maximum(1, df[(hashes % np.uint64(BUCKETS)).astype(np.int64)]))


def _blocks(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    size = chars = 0
    for pdf in batches:
        for a in range(0, len(pdf), 2000):
            held.append(pdf.iloc[a : a + 2000])
            size += len(held[-1])
            chars += int(held[-1]["text"].str.len().sum())
            if size >= rows or chars > 6_000_000:
                yield pd.concat(held)
                held, size, chars = [], 0, 0
    if size:
        yield pd.concat(held)


def document_frequencies(reps: DataFrame, kind: str, size: int) -> np.ndarray:
    """In how many texts each bucket's shingles occur; summed in each partition before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for block in _blocks(batches, 4000):
            _, hashes, _ = shingles(block["text"].tolist(), kind, size)
            total += np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    df = np.zeros(BUCKETS, dtype=np.int64)
    sums = reps.select("text").mapInPandas(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df[sums["bucket"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    return df


def _tables(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), for the samples' steps (4,096) and the logarithms of their levels (65,536)."""
    rng = np.random.default_rng(seed)

    def gamma(n: int) -> np.ndarray:
        return np.sort(rng.gamma(2.0, 1.0, size=n * 16)).reshape(n, 16).mean(axis=1)

    return gamma(4096).astype(np.float32), np.log(gamma(65536)).astype(np.float32)


def signatures(texts: list[str], kind: str, size: int, df: np.ndarray, n: int, hashes: int | range | list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Consistent weighted samples of each text (one row each, identified by their level) and its number of shingles, for the first ``hashes`` hashes or those listed.

    For a shingle of weight w and each hash: step r and level c are Gamma(2, 1), b uniform, all from the shingle's hash;
    t = floor(ln w / r + b), and the text's sample is the shingle with the least ln c - r (t - b) - r. Two texts have the
    same sample with the probability of their weighted Jaccard similarity.
    """
    steps, levels = _tables()
    hashes = list(range(hashes) if isinstance(hashes, int) else hashes)
    owner, shingle, tf = shingles(texts, kind, size)
    counts = np.bincount(owner, minlength=len(texts))
    out = np.full((len(texts), len(hashes)), np.inf, dtype=np.float32)
    if not len(owner):
        return out, counts
    # equal weights are sampled once: a shingle with the rank of its number of occurrences, of which a block has under 2^21
    times, rank = np.unique(tf, return_inverse=True)
    distinct, at = np.unique((shingle << np.uint64(21)) | rank.astype(np.uint64), return_inverse=True)
    own = distinct >> np.uint64(21)
    lnw = np.log(_weights(own, times[(distinct & np.uint64((1 << 21) - 1)).astype(np.int64)], df, n)).astype(np.float32)
    # frequent shingles lie together, so that their levels stay in the processor's cache
    order = np.argsort(-np.bincount(at, minlength=len(own)), kind="stable")
    moved = np.empty(len(order), dtype=np.int64)
    moved[order] = np.arange(len(order))
    own, lnw, at = own[order], lnw[order], moved[at]
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    present = owner[starts]
    for place, j in enumerate(hashes):
        bits = _mix(own + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        r = steps[(bits & np.uint64(4095)).astype(np.int64)]
        b = ((bits >> np.uint64(12)) & np.uint64(4095)).astype(np.float32) * np.float32(1 / 4096)
        c = levels[((bits >> np.uint64(24)) & np.uint64(65535)).astype(np.int64)]
        level = c - r * (np.floor(lnw / r + b) - b) - r
        out[present, place] = np.minimum.reduceat(level[at], starts)
    return out, counts


_NONE = np.uint32(0xFFFFFFFF)


def samples(owner: np.ndarray, shingle: np.ndarray, texts: int, count: int, rounds: int = 24) -> np.ndarray:
    """``count`` samples of each text's shingle set (one row each; ``_NONE`` where a text has no shingle), from ``shingles``.

    In each round every shingle falls into one place by its hash; a place keeps the shingle of its first round, and of that
    the one with the least hash. Places still empty after ``rounds`` keep the least of all hashes made for that place. In
    each place every shingle of a union is as likely as another to be kept, so two texts have the same sample with the
    probability of their Jaccard similarity. Texts without an empty place are left out of further rounds, which changes nothing.
    """
    out = np.full(texts * count, _NONE, dtype=np.uint32)
    sizes = np.bincount(owner, minlength=texts)
    own, left, row = owner, shingle, owner * count
    for i in range(0, rounds, 2):
        bits = left * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 3) & 0xFFFFFFFFFFFFFFFF)
        bits ^= bits >> np.uint64(32)
        bits *= np.uint64(0xBF58476D1CE4E5B9)
        bits ^= bits >> np.uint64(29)
        for half in (0, 1):
            part = (bits >> np.uint64(32 * half)).astype(np.uint32)
            place = (part & np.uint32(0xFFFF)) * np.uint32(count) >> np.uint32(16)
            np.minimum.at(out, row + place, (part >> np.uint32(16)) | np.uint32((i + half) << 16))
        if i % 4 == 2:
            keep = (out.reshape(texts, count) == _NONE).any(axis=1)[own]
            if not keep.all():
                own, left, row = own[keep], left[keep], row[keep]
            if not len(own):
                break
    out = out.reshape(texts, count)
    first = np.cumsum(sizes) - sizes
    text, place = np.nonzero((out == _NONE) & (sizes > 0)[:, None])
    for a in range(0, len(text), 8192):
        t, p = text[a : a + 8192], place[a : a + 8192]
        ends = np.cumsum(sizes[t])
        begins = ends - sizes[t]
        at = np.repeat(first[t] - begins, sizes[t]) + np.arange(ends[-1])
        value = _mix(shingle[at] + np.repeat((p + 1).astype(np.uint64), sizes[t]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        # later than any round
        out[t, p] = (np.minimum.reduceat(value, begins) | np.uint64(1 << 31)).astype(np.uint32)
    return out


def similarity(a: str, b: str, kind: str, size: int, df: np.ndarray | None, n: int) -> float:
    """Weighted Jaccard of the TF-IDF shingles; without ``df`` the plain Jaccard of the shingle sets."""
    owner, h, tf = shingles([a, b], kind, size)
    ha, hb = h[owner == 0], h[owner == 1]
    if df is None:
        both = len(np.intersect1d(ha, hb, assume_unique=True))
        return both / max(1, len(ha) + len(hb) - both)
    wa, wb = _weights(ha, tf[owner == 0], df, n), _weights(hb, tf[owner == 1], df, n)
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    return float(both / max(1e-12, np.maximum(wa[i], wb[j]).sum() + np.delete(wa, i).sum() + np.delete(wb, j).sum()))


def representatives(texts: DataFrame, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One row for each distinct normalised text of a table (``tbl``, ``rep``, ``text``), and the membership (``tbl``, ``id``, ``rep``) of texts that occur more than once.

    Rows in ``gone`` (``tbl``, ``id``) take no part. Copies are counted on hashes; each text itself is shuffled once.
    """
    # normalised once
    keyed = materialise(texts.select("tbl", "id", F.unhex(F.md5("text")).alias("h"), "text"), "keyed")
    keys = keyed.select("tbl", "id", "h")
    if gone is not None:
        keys = keys.join(gone, ["tbl", "id"], "left_anti")
    keys = materialise(keys, "keys")
    first = keys.groupBy("tbl", "h").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = materialise(keyed.join(first.select("tbl", F.col("rep").alias("id")), ["tbl", "id"]).select("tbl", F.col("id").alias("rep"), "text"), "reps")
    return reps, keys.join(first.where("copies > 1"), ["tbl", "h"]).select("tbl", "id", "rep")


def banding(at_least: float, missed: float = 1e-4, more: int = 0) -> tuple[int, int]:
    """Bands and samples a band (by ``more`` above the usual number), so that a pair of weighted similarity ``at_least`` meets in no band with a probability of ``missed`` at most."""
    rows = max(1, round(1 + 5 * at_least)) + more
    agree = min(max(at_least, 0.05) ** rows, 1 - 1e-9)
    return max(1, math.ceil(math.log(missed) / math.log1p(-agree))), rows


#: Plain sets get one more sample a band, and the bands for it, for every five times more texts than this.
MANY_TEXTS = 500_000


def pairs(reps: DataFrame, *, kind: str = "words", size: int = 5, at_least: float = 0.8, weighted: bool = True, bands: int | None = None, rows: int | None = None, waves: int = 4) -> DataFrame:
    """Pairs of representatives (``tbl``, ``a`` < ``b``, ``similarity``) at ``at_least`` or more.

    ``bands`` bands of ``rows`` samples, by ``at_least`` unless given (see ``banding``); rows that agree in a band meet (see ``_met``)
    and are verified on their whole texts: by weighted Jaccard, or with ``weighted=False`` by the plain Jaccard of the shingle
    sets. Those are sampled without weights, and what their sketches rule out does not leave the band. Bands are shuffled in
    three times ``waves`` and the texts of candidates in ``waves``, each written before the next begins, so that only one wave's
    shuffle lies on disk at a time; the result is the same.
    """
    n = max(1, reps.count())
    if bands is None or rows is None:
        bands, rows = banding(at_least, more=0 if weighted else max(0, math.ceil(math.log(n / MANY_TEXTS, 5))))
    shared = reps.sparkSession.sparkContext.broadcast(document_frequencies(reps, kind, size).astype(np.int32)) if weighted else None
    names = sorted(r.tbl for r in reps.select("tbl").distinct().limit(MOST_TABLES + 1).collect())
    if len(names) > MOST_TABLES:
        raise ValueError(f"more than {MOST_TABLES} tables")
    dealt = [range(wave, bands, min(3 * waves, bands)) for wave in range(min(3 * waves, bands))]
    signed = materialise(_signed(reps, names, dealt, rows, kind, size, shared, n), "signed")
    met = None
    for wave, own in enumerate(dealt):
        one = materialise(_met(signed.select("head", f"w{wave}"), len(own), n, None if weighted else at_least), "met")
        met = one if met is None else met.unionByName(one)
    tbl = F.element_at(F.array(*[F.lit(t) for t in names] or [F.lit("")]), F.col("code") + 1)
    met = materialise(met.distinct().select(tbl.alias("tbl"), "a", "b"), "candidates")
    there = materialise(met.select("tbl", F.col("a").alias("rep")).unionByName(met.select("tbl", F.col("b").alias("rep"))).distinct(), "there")
    text = materialise(reps.select("tbl", "rep", "text").join(small(there), ["tbl", "rep"], "left_semi"), "texts")
    of_wave = lambda c, wave: F.pmod(F.xxhash64(c), F.lit(waves)) == wave
    out = None
    for wave in range(waves):
        both = met.where(of_wave("a", wave)).join(text.where(of_wave("rep", wave)).toDF("tbl", "a", "ta"), ["tbl", "a"]).join(text.toDF("tbl", "b", "tb"), ["tbl", "b"])
        one = materialise(both.select("tbl", "a", "b", "ta", "tb").mapInPandas(_verifier(kind, size, at_least, shared, n), "tbl string, a bigint, b bigint, similarity double"), "pairs")
        out = one if out is None else out.unionByName(one)
    return out


def _width(sizes: np.ndarray) -> np.ndarray:
    """Words of a text's parity sketch by its number of shingles: 8 up to 384, then twice as many for every doubling, 256 at most."""
    return 8 << np.searchsorted(384 << np.arange(5), sizes)


def _parities(owner: np.ndarray, shingle: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each of the six widths the sketches of the texts that have it, in their order: a bit is the parity of the number of shingles of its residue.

    The sketch of half the width is the exclusive or of the halves.
    """
    width = _width(sizes)
    out = []
    for words in 8 << np.arange(6):
        own = width == words
        place = np.cumsum(own) - 1
        there = own[owner]
        bit = place[owner[there]] * (words * 64) + ((shingle[there] >> np.uint64(20)) % np.uint64(words * 64)).astype(np.int64)
        odd = np.bincount(bit, minlength=int(own.sum()) * int(words) * 64) & 1
        out.append(np.packbits(odd.astype(bool)).view(np.uint64).reshape(-1, words))
    return out


def _allowed(total: np.ndarray, words: int, at_least: float) -> np.ndarray:
    """The most differing bits that the sketches of two texts with ``total`` shingles may have.

    A pair of Jaccard similarity t has d = total (1 - t) / (1 + t) shingles in one text only, and every differing bit stands for one of
    these at least. Several may share a bit; then so many bits as expected for d and 5.5 standard deviations more (a pair
    at ``at_least`` is above that with a probability of 2e-8).
    """
    m, d = words * 64, total * ((1 - at_least) / (1 + at_least))
    even = np.exp(d * math.log1p(-2 / m))
    return np.minimum(d, m / 2 * (1 - even) + 5.5 * np.sqrt(m * (1 - even**2)) / 2) + 1e-6


#: One entry of a band: its key, the record, its number of shingles and the code of its table. Sketches follow, by width.
_ENTRY = np.dtype([("key", "<u4"), ("rep", "<i8"), ("size", "<u4"), ("code", "<u2")])


def _packed(entries: np.ndarray, sketches: list[np.ndarray]) -> bytes:
    return b"".join([np.array([len(entries)] + [len(x) for x in sketches], dtype=np.int64).tobytes(), entries.tobytes(), *[x.tobytes() for x in sketches]])


def _unpacked(packed) -> tuple[np.ndarray, list[np.ndarray]]:
    """Entries and sketches of ``_packed``; the sketches are empty if none were kept."""
    counts = np.frombuffer(packed, np.int64, 7)
    entries = np.frombuffer(packed, _ENTRY, counts[0], 56)
    at, sketches = 56 + entries.nbytes, []
    for words, count in zip(8 << np.arange(6), counts[1:], strict=True):
        sketches.append(np.frombuffer(packed, np.uint64, count * words, at).reshape(-1, words))
        at += sketches[-1].nbytes
    return entries, sketches


def _picked(rows: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray]) -> list[np.ndarray]:
    """The sketches of the ``rows``, in their order, out of those of all rows with these ``sizes``."""
    width = _width(sizes)
    return [x[(np.cumsum(width == words) - 1)[rows[width[rows] == words]]] if len(x) else x for words, x in zip(8 << np.arange(6), sketches, strict=True)]


def _signed(reps: DataFrame, names: list[str], dealt: list[range], rows: int, kind: str, size: int, shared, n: int) -> DataFrame:
    """Blocks of texts in columns of packed numbers: ``head`` (see ``_packed``) and for each wave its bands' keys ``w0``, ``w1``..., band by band.

    With ``shared`` document frequencies the samples are weighted, and there are no sketches.
    """
    codes = {t: c for c, t in enumerate(names)}
    count = sum(len(bands) for bands in dealt) * rows

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, 4000 if shared is None else 16000):
            texts = block["text"].tolist()
            if shared is None:
                owner, shingle, _ = shingles(texts, kind, size)
                sizes, sampled = np.bincount(owner, minlength=len(texts)), samples(owner, shingle, len(texts), count)
                sketches = _parities(owner, shingle, sizes)
            else:
                sampled, sizes = signatures(texts, kind, size, shared.value, n, count)
                sampled, sketches = sampled.view(np.uint32), [np.empty((0, words), np.uint64) for words in 8 << np.arange(6)]
            salt = np.array([_word_code(t) for t in names], dtype=np.uint64)[(code := np.array([codes[t] for t in block["tbl"]], dtype=np.int64))]
            there = np.flatnonzero(sizes > 0)
            head = np.zeros(len(there), dtype=_ENTRY)
            head["rep"], head["size"], head["code"] = block["rep"].to_numpy()[there], sizes[there], code[there]
            keys = []
            for bands in dealt:
                wave = np.empty((len(bands), len(there)), dtype=np.uint32)
                for place, k in enumerate(bands):
                    key = salt + np.uint64(k)
                    for j in range(rows):
                        key = _mix(key * np.uint64(31) + sampled[:, k * rows + j].astype(np.uint64))
                    wave[place] = (key >> np.uint64(32)).astype(np.uint32)[there]
                keys.append(wave.tobytes())
            yield pd.DataFrame({"head": [_packed(head, _picked(there, sizes, sketches))]} | {f"w{i}": [k] for i, k in enumerate(keys)})

    return reps.select("tbl", "rep", "text").mapInPandas(sign, "head binary, " + ", ".join(f"w{i} binary" for i in range(len(dealt))))


#: So many entries of a wave's bands meet in one task, about, and so many pairs are looked at together.
ENTRIES, PAIRS = 400_000, 200_000


def _met(signed: DataFrame, bands: int, n: int, at_least: float | None) -> DataFrame:
    """Pairs (``code`` of the table, ``a`` < ``b``) whose keys agree in a band of a wave (``head`` and the wave's keys), once for each such band.

    An equi-join on the key: every part of the range of keys goes to one task, packed, and is sorted there. With ``at_least`` pairs that
    their sizes and sketches rule out are left out (see ``_allowed``). A key of many texts gives its pairs piece by piece.
    """
    parts = max(shuffle_partitions(signed.sparkSession), math.ceil(n * bands / ENTRIES))
    wave = signed.columns[1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, keys in zip(batch.column("head"), batch.column(wave), strict=True):
                head, sketches = _unpacked(packed.as_buffer())
                keys = np.frombuffer(keys.as_buffer(), np.uint32)
                part = (keys.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)
                order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts), side="right")
                texts, blobs = order % max(1, len(head)), []
                for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                    own = head[texts[a:b]]
                    own["key"] = keys[order[a:b]]
                    blobs.append(_packed(own, _picked(texts[a:b], head["size"], sketches)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array(blobs, pa.binary())], ["part", "packed"])

    def near(x: np.ndarray, y: np.ndarray, entries: np.ndarray, width: np.ndarray, place: np.ndarray, sketches: list[np.ndarray]) -> pa.RecordBatch:
        rep, code, sizes = entries["rep"], entries["code"], entries["size"]
        ok = (code[x] == code[y]) & (rep[x] != rep[y])
        if at_least is not None:
            nx, ny = sizes[x], sizes[y]
            ok &= np.minimum(nx, ny) >= at_least * np.maximum(nx, ny)
        x, y = x[ok], y[ok]
        if at_least is not None:
            close = _close(x, y, sizes, width, place, sketches, at_least)
            x, y = x[close], y[close]
        a, b = rep[x], rep[y]
        return pa.RecordBatch.from_arrays([pa.array(code[x].astype(np.int32)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["code", "a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpacked(x.as_buffer()) for batch in batches for x in batch.column("packed")]
        if not held:
            return
        entries = np.concatenate([x for x, _ in held])
        sketches = [np.concatenate(x) for x in zip(*[x for _, x in held], strict=True)]
        order = np.argsort(entries["key"], kind="stable")
        key = entries["key"][order]
        # where a text's sketch is among those of its width
        width, place = _width(entries["size"]), np.zeros(len(entries), dtype=np.int64)
        for words in 8 << np.arange(6):
            own = width == words
            place[own] = np.arange(own.sum())
        at, apart, left, right, waiting = np.arange(len(key)), 1, [], [], 0
        while len(at := at[at + apart < len(key)]) and len(at := at[key[at] == key[at + apart]]):
            for k in range(0, len(at), PAIRS):
                left.append(at[k : k + PAIRS])
                right.append(left[-1] + apart)
                waiting += len(left[-1])
                if waiting >= PAIRS:
                    yield near(order[np.concatenate(left)], order[np.concatenate(right)], entries, width, place, sketches)
                    left, right, waiting = [], [], 0
            apart += 1
        if waiting:
            yield near(order[np.concatenate(left)], order[np.concatenate(right)], entries, width, place, sketches)

    return signed.mapInArrow(deal, "part int, packed binary").repartitionById(parts, F.col("part")).mapInArrow(meet, "code int, a bigint, b bigint")


def _close(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, width: np.ndarray, place: np.ndarray, sketches: list[np.ndarray], at_least: float) -> np.ndarray:
    """Whether the sketches leave the pairs ``x``, ``y`` open, wider ones folded to the narrower."""
    out = np.zeros(len(x), dtype=bool)
    wx, wy = width[x], width[y]
    for both in np.flatnonzero(np.bincount(wx << 9 | wy)):
        own = np.flatnonzero((wx << 9 | wy) == both)
        i, j = int(both >> 9).bit_length() - 4, int(both & 511).bit_length() - 4
        a, b = sketches[i][place[x[own]]], sketches[j][place[y[own]]]
        while a.shape[1] > b.shape[1]:
            a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
        while b.shape[1] > a.shape[1]:
            b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
        total = sizes[x[own]].astype(np.float64) + sizes[y[own]]
        differ = np.bitwise_count(a ^ b).astype(np.float32) @ np.ones(a.shape[1], np.float32)
        out[own] = differ <= _allowed(total, a.shape[1], at_least)
    return out


#: Sketches have this many words of 64 bits.
SKETCH = 16


def _bits(texts: list[str], kind: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text one bit for every residue that its shingles' hashes have, as ``SKETCH`` words, and its number of shingles."""
    owner, hashes, _ = shingles(texts, kind, size)
    bits = np.zeros((len(texts), SKETCH * 64), dtype=bool)
    bits[owner, ((hashes >> np.uint64(20)) % np.uint64(SKETCH * 64)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.int64), np.bincount(owner, minlength=len(texts))


def _sketches(reps: DataFrame, names: list[str], kind: str, size: int) -> DataFrame:
    """``code`` of the table, ``rep``, number of shingles ``n`` and the words ``s0``, ``s1``... of each text's sketch."""
    codes = {t: c for c, t in enumerate(names)}

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, 16000):
            words, counts = _bits(block["text"].tolist(), kind, size)
            yield pd.DataFrame({"code": [codes[t] for t in block["tbl"]], "rep": block["rep"].to_numpy(), "n": counts} | {f"s{i}": words[:, i] for i in range(SKETCH)})

    return reps.mapInPandas(sketch, "code int, rep bigint, n bigint, " + ", ".join(f"s{i} bigint" for i in range(SKETCH)))


def _near(met: DataFrame, sketches: DataFrame, at_least: float, parts: list[Column]) -> DataFrame:
    """The pairs of ``met`` that the sketches don't rule out, one part after the other.

    Every bit that only one sketch has stands for at least one shingle that only this text has, and a pair of Jaccard similarity t
    has (1 - t) / (1 + t) of both texts' shingles in one of them only: no pair at ``at_least`` is lost.
    """
    side = lambda c: sketches.select("code", F.col("rep").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in sketches.columns[2:]])
    apart = sum((F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(SKETCH)), F.lit(0))
    close = apart * (1 + at_least) <= (F.col("a_n") + F.col("b_n")) * (1 - at_least) + 1e-6
    out = None
    for part in parts:
        one = materialise(met.where(part).join(side("a"), ["code", "a"]).join(side("b"), ["code", "b"]).where(close).select("code", "a", "b"), "near")
        out = one if out is None else out.unionByName(one)
    return out


#: So many tables can be searched at once; more raise an error.
MOST_TABLES = 1024


def _verifier(kind: str, size: int, at_least: float, shared, n: int):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if shared is not None:
                s = np.array([similarity(x, y, kind, size, shared.value, n) for x, y in zip(pdf["ta"], pdf["tb"], strict=True)], dtype=np.float64)
            else:
                s = _set_jaccard(pdf["ta"].tolist(), pdf["tb"].tolist(), kind, size)
            keep = s >= at_least
            yield pd.DataFrame({"tbl": pdf["tbl"][keep], "a": pdf["a"][keep], "b": pdf["b"][keep], "similarity": s[keep]})

    return verify


def _set_jaccard(left: list[str], right: list[str], kind: str, size: int) -> np.ndarray:
    """Jaccard of the shingle sets of many pairs at once."""
    oa, ha, _ = shingles(left, kind, size)
    ob, hb, _ = shingles(right, kind, size)
    na, nb = np.bincount(oa, minlength=len(left)), np.bincount(ob, minlength=len(left))
    key = np.concatenate([(oa.astype(np.uint64) << np.uint64(43)) | ha, (ob.astype(np.uint64) << np.uint64(43)) | hb])
    key.sort(kind="stable")
    same = key[1:][key[1:] == key[:-1]]
    both = np.bincount((same >> np.uint64(43)).astype(np.int64), minlength=len(left))
    return both / np.maximum(1, na + nb - both)


def groups(links: DataFrame, reps: DataFrame) -> DataFrame:
    """One row for each representative with its group (the smallest one linked to it over any number of links) and its number of links.

    Labels shrink along the links and jump over their own labels until nothing changes; each round is written to the shared folder.
    """
    both = materialise(links.select("tbl", F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select("tbl", F.col("b").alias("rep"), F.col("a").alias("other"))), "links")
    label = materialise(both.groupBy("tbl", "rep").agg(F.least(F.min("rep"), F.min("other")).alias("group")), "labels")
    while True:
        near = both.join(label.select("tbl", F.col("rep").alias("other"), F.col("group").alias("theirs")), ["tbl", "other"]).groupBy("tbl", "rep").agg(F.min("theirs").alias("theirs"))
        jump = label.select("tbl", F.col("rep").alias("group"), F.col("group").alias("jumped"))
        moved = label.join(near, ["tbl", "rep"]).join(jump, ["tbl", "group"]).select("tbl", "rep", F.least("group", "theirs", "jumped").alias("new"), F.col("group").alias("old"))
        moved = materialise(moved, "labels")
        label = moved.select("tbl", "rep", F.col("new").alias("group"))
        if moved.where("new < old").isEmpty():
            break
    degree = both.groupBy("tbl", "rep").agg(F.count("*").alias("n_links"))
    placed = label.join(degree, ["tbl", "rep"])
    return reps.select("tbl", "rep").join(placed, ["tbl", "rep"], "left").select("tbl", "rep", F.coalesce("group", "rep").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def placed(grouped: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each record (``tbl``, ``id``) with its representative and that one's group and links (see ``groups``)."""
    copies = members.where("id <> rep").join(grouped, ["tbl", "rep"])
    return grouped.withColumn("id", F.col("rep")).unionByName(copies).select("tbl", "id", "rep", "group", "n_links")


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of records behind links of representatives: copies of either side, and the copies of one text among themselves (``tbl``, ``id_a`` < ``id_b``)."""
    own = members.select("tbl", F.col("rep").alias("a"), F.col("id").alias("ia"))
    other = members.select("tbl", F.col("rep").alias("b"), F.col("id").alias("ib"))
    spread = links.join(own, ["tbl", "a"], "left").join(other, ["tbl", "b"], "left").select("tbl", F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"))
    equal = own.join(other.withColumnRenamed("b", "a"), ["tbl", "a"]).where("ia < ib").select("tbl", F.col("ia").alias("x"), F.col("ib").alias("y"))
    return spread.unionByName(equal).select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def prepared(texts: DataFrame, content: Column, shortest: int) -> DataFrame:
    """``tbl``, ``id`` and normalised ``text`` of the rows with at least ``shortest`` characters; null content takes no part."""
    return texts.select("tbl", "id", normalised(content).alias("text")).where(F.length("text") >= shortest)
