"""The most similar vectors of every vector, through a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.session import materialise

_LOG = logging.getLogger(__name__)

#: A tree is fitted on no more than about this many vectors.
MOST_SAMPLED = 200_000

#: No tree of less recall on its sample is used, unless less is asked for.
LEAST_RECALL = 0.9

#: How far below the margin inner bins are still opened.
OPEN_BELOW = 0.12

#: The load of the leaves is estimated on one of so many rows.
LOAD_SHARE = 8


@dataclass(frozen=True)
class Tree:
    """Unit centroids of all nodes; ``children[n]`` is the range of a node's children, empty for a leaf."""

    centres: np.ndarray
    children: list[tuple[int, int]]
    #: A leaf is visited while its centroid is at most this much less similar than the best one.
    margin: float
    #: No query visits more leaves than this; chosen with the margin, so that the recall is reached.
    visits: int
    #: The recall reached on the sample.
    recall: float = 1.0


def usable(vector: Column, width: int) -> Column:
    """Has ``width`` values, all present and finite, and is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == width) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=k, replace=False)].copy()
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        label = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        norms = np.linalg.norm(sums, axis=1)
        empty = norms < 1e-9
        sums[empty] = x[rng.choice(len(x), size=int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
    return centres, np.argmax(x @ centres.T, axis=1)


def fit(sample: np.ndarray, leaves: int, branching: int, seed: int = 7) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Split the sample of unit vectors by k-means, the fullest node first, until there are ``leaves`` leaves."""
    centres, children, members = [sample.mean(axis=0)], [(0, 0)], [np.arange(len(sample))]
    open_nodes, n_leaves = [0], 1
    while open_nodes and n_leaves < leaves:
        node = max(open_nodes, key=lambda n: len(members[n]))
        open_nodes.remove(node)
        own = members[node]
        k = min(branching, len(own) // 8, leaves - n_leaves + 1)
        if k < 2 or (sample[own] == sample[own[0]]).all():
            continue  # equal vectors can't be parted
        c, label = _kmeans(sample[own], k, 8, seed + node)
        full = np.unique(label)
        if len(full) < 2:
            continue
        first = len(centres)
        for j in full:
            centres.append(c[j])
            children.append((0, 0))
            members.append(own[label == j])
            open_nodes.append(first + j)
        children[node] = (first, first + len(full))
        n_leaves += len(full) - 1
    return np.array(centres, dtype=np.float32), children


def search(tree: Tree, x: np.ndarray, margin: float | None = None, visits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best bin first for a block of unit vectors: (row, leaf, rank of the visit), nearest leaf first.

    Each row has its own priority queue, kept as a row of similarities to all nodes on its frontier; each round every row pops
    its best node and either visits it (a leaf) or pushes its children. A row stops when its next bin is too far
    below its best leaf, or after ``visits`` leaves.
    """
    margin, visits = tree.margin if margin is None else margin, tree.visits if visits is None else visits
    n = len(x)
    queue = np.full((n, len(tree.centres)), -np.inf, dtype=np.float32)
    queue[:, 0] = 2.0
    best, count = np.full(n, -np.inf, dtype=np.float32), np.zeros(n, dtype=np.int64)
    active, rows, leaves, ranks = np.arange(n), [], [], []
    inner = np.array([b > a for a, b in tree.children])
    while len(active):
        node = np.argmax(queue[active], axis=1)
        value = queue[active, node]
        # a leaf is visited within the margin; inner bins are opened some way below it, as their children may be nearer
        go = value >= best[active] - margin - OPEN_BELOW
        active, node, value = active[go], node[go], value[go]
        queue[active, node] = -np.inf
        leaf = ~inner[node] & (value >= best[active] - margin)
        if leaf.any():
            at = active[leaf]
            best[at] = np.maximum(best[at], value[leaf])
            rows.append(at)
            leaves.append(node[leaf])
            ranks.append(count[at].copy())
            count[at] += 1
        for p in np.unique(node[inner[node]]):
            at = active[node == p]
            a, b = tree.children[p]
            queue[at[:, None], np.arange(a, b)] = x[at] @ tree.centres[a:b].T
        active = active[count[active] < visits]
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(ranks)


def calibrate(centres: np.ndarray, children: list[tuple[int, int]], sample: np.ndarray, at_least: float, recall: float, visits: int, asked: int = 5000) -> tuple[float, int, float]:
    """Widen the margin and the number of visits until the pairs of the sample at ``at_least`` or more meet in a leaf often enough: (margin, visits, recall reached).

    Visits start at ``visits`` and double, up to all leaves, where most missed pairs ran out of them; else the margin is widened.
    A pair meets if either side visits the leaf the other lives in; pairs of equal vectors always do and don't count. The first ``asked`` rows are held against brute force over the whole sample.
    """
    pairs = []
    for a in range(0, min(asked, len(sample)), 256):
        i, j = np.nonzero(sample[a : a + 256] @ sample.T >= at_least)
        i, j = i[i + a != j] + a, j[i + a != j]
        keep = (sample[i] != sample[j]).any(axis=1)
        pairs.append(np.stack([i[keep], j[keep]], axis=1))
    pairs = np.concatenate(pairs)
    if not len(pairs):
        return 0.1, visits, 1.0
    used, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(pairs.shape)
    margin, n_leaves = 0.03, sum(a == b for a, b in children)
    while True:
        parts = [(c, search(Tree(centres, children, margin, visits), sample[used[c : c + 2000]])) for c in range(0, len(used), 2000)]
        rows = np.concatenate([c + found[0] for c, found in parts])
        leaves, ranks = (np.concatenate([found[p] for _, found in parts]) for p in (1, 2))
        home = np.zeros(len(used), dtype=np.int64)
        home[rows[ranks == 0]] = leaves[ranks == 0]
        seen = np.unique(rows * len(centres) + leaves)
        meets = np.isin(at[:, 0] * len(centres) + home[at[:, 1]], seen) | np.isin(at[:, 1] * len(centres) + home[at[:, 0]], seen)
        reached = float(meets.mean())
        # with all leaves within the widest margin every pair meets
        if reached >= recall or (visits >= n_leaves and margin > 2):
            return margin, visits, reached
        spent = (np.bincount(rows, minlength=len(used)) >= visits)[at[~meets]].any(axis=1)
        if visits < n_leaves and (spent.mean() > 0.5 or margin > 2):
            visits = min(2 * visits, n_leaves)
        else:
            margin *= 1.25


def build(vectors: DataFrame, n: int, *, at_least: float, leaf_size: int, max_leaves: int, per_leaf: int, branching: int, recall: float, visits: int) -> Tree:
    """A tree fitted on a sample of ``vectors`` chosen by a hash of the id: ``per_leaf`` for each leaf, 40,000 at least, ``MOST_SAMPLED`` at most."""
    leaves = max(1, min(max_leaves, n // leaf_size))
    wanted = min(MOST_SAMPLED, max(40_000, leaves * per_leaf))
    share = min(1.0, wanted / max(1, n))
    drawn = vectors.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)).select("vector").limit(2 * MOST_SAMPLED)
    sample = np.array([r[0] for r in drawn.toPandas().itertuples(index=False)], dtype=np.float32)
    if not len(sample):
        return Tree(np.zeros((1, 1), np.float32), [(0, 0)], 0.0, 1)
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    centres, children = fit(sample, leaves, branching)
    margin, visits, reached = calibrate(centres, children, sample, at_least, recall, visits)
    _LOG.info("%d nodes, margin %.3f, %d visits: recall %.4f on the sample", len(centres), margin, visits, reached)
    if reached < min(recall, LEAST_RECALL):
        raise ValueError(f"recall {reached:.4f} on the sample, {recall} wanted")
    return Tree(centres, children, margin, visits, reached)


def _unit(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack(column.to_numpy()).astype(np.float64)
    return x, np.linalg.norm(x, axis=1)


def nearest(
    vectors: DataFrame,
    *,
    k: int = 5,
    at_least: float = 0.86,
    width: int = 64,
    leaf_size: int = 500,
    max_leaves: int = 4096,
    per_leaf: int = 50,
    branching: int = 64,
    recall: float = 0.999,
    visits: int = 16,
    block: int = 4000,
) -> DataFrame:
    """For every usable vector its ``k`` most similar others with cosine (double, 6 places) of at least ``at_least``: ``id``, ``other``, ``cosine``, ``rank``.

    ``vectors`` needs unique ``id`` and ``vector``; further columns are not read. Null, wrong-width, non-finite and zero vectors
    take no part. Ties go to the smaller id. Equal vectors are indexed ``k + 1`` times (the smallest ids), which settles the
    result for all of them exactly, so one vector that makes up a third of all rows is no hot leaf.

    The index is a hierarchical k-means tree fitted on a bounded sample (``MOST_SAMPLED``); every row
    lives in the leaf of its best bin and visits further leaves, best bin first, as far as the margin and the number of visits
    calibrated on the sample ask (``visits`` is where their number starts). The search inside a leaf is exact. A leaf with more than ``block``
    visits is cut: blocks of its homes meet blocks of its visits.
    """
    usable_rows = vectors.where(usable(F.col("vector"), width)).select("id", "vector")
    hashed = usable_rows.select("id", F.xxhash64("vector", F.lit(3)).alias("h1"), F.md5(F.concat_ws(",", "vector")).alias("h2"))
    copies = hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > k + 1)
    crowded = materialise(hashed.join(F.broadcast(copies) if copies.limit(10_001).count() <= 10_000 else copies, ["h1", "h2"], "left_semi"), "crowded")
    order = Window.partitionBy("h1", "h2").orderBy("id")
    lead = crowded.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    surplus = crowded.join(lead.select("id"), "id", "left_anti")
    indexed = usable_rows.join(surplus.select("id"), "id", "left_anti") if not crowded.isEmpty() else usable_rows
    # the surplus copies would crowd the sample
    tree = build(indexed, indexed.count(), at_least=at_least, leaf_size=leaf_size, max_leaves=max_leaves, per_leaf=per_leaf, branching=branching, recall=recall, visits=visits)
    shared = vectors.sparkSession.sparkContext.broadcast((tree.centres, tree.children, tree.margin, tree.visits))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown = Tree(*shared.value)
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                x, norm = _unit(part["vector"])
                row, leaf, rank = search(grown, (x / norm[:, None]).astype(np.float32))
                yield pd.DataFrame({"leaf": leaf, "id": part["id"].to_numpy()[row], "home": rank == 0, "vector": part["vector"].to_numpy()[row]})

    bins = indexed.mapInPandas(place, "leaf int, id bigint, home boolean, vector array<float>")
    # how a leaf is cut only balances the tasks: estimated on a share of the rows
    some = indexed.where(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(LOAD_SHARE)) == 0)
    loads = some.mapInPandas(_leaf_loads(shared), "leaf int, homes bigint, visits bigint").groupBy("leaf").agg((F.sum("homes") * LOAD_SHARE).alias("homes"), (F.sum("visits") * LOAD_SHARE).alias("visits"))
    big = {r.leaf: (max(1, -(-r.homes // block)), -(-r.visits // block)) for r in loads.where(F.col("visits") > block).collect()}  # at most max_leaves rows
    # the homes of a leaf are cut into blocks and its visits too; in a tile one block meets the other
    pieces = [F.lit(1), F.lit(1)]
    if big:
        for side in (0, 1):
            pieces[side] = F.coalesce(F.element_at(F.create_map(*[F.lit(int(v)) for leaf, cut in big.items() for v in (leaf, cut[side])]), F.col("leaf")), F.lit(1))
    own_a, own_b = F.pmod(F.xxhash64("id"), pieces[0]).cast("int"), F.pmod(F.xxhash64("id", F.lit(5)), pieces[1]).cast("int")
    visit = F.transform(F.sequence(F.lit(0), pieces[0] - 1), lambda a: F.struct(a.alias("a"), own_b.alias("b"), (F.col("home") & (a == own_a)).alias("as_home"), F.lit(True).alias("as_other")))
    lives = F.transform(F.filter(F.sequence(F.lit(0), pieces[1] - 1), lambda b: F.col("home") & (b != own_b)), lambda b: F.struct(own_a.alias("a"), b.alias("b"), F.lit(True).alias("as_home"), F.lit(False).alias("as_other")))
    spread = bins.withColumn("tile", F.explode(F.concat(visit, lives))).select("leaf", "id", "vector", "tile.*")

    def best(ids: np.ndarray, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> pd.DataFrame:
        sort = np.lexsort((ids[j], -cos, i))
        i, j, cos = i[sort], j[sort], cos[sort]
        start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.empty(0, np.int64)
        nth = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
        top = nth < k
        return pd.DataFrame({"id": ids[i[top]], "other": ids[j[top]], "cosine": cos[top]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, norm = _unit(pdf["vector"])
        u = x / norm[:, None]
        ids = pdf["id"].to_numpy()
        rows, cols = np.flatnonzero(pdf["as_home"].to_numpy()), np.flatnonzero(pdf["as_other"].to_numpy())
        u32 = u.astype(np.float32)
        c32, out, found = u32[cols].T, [], []
        for a in range(0, len(rows), 512):
            r = rows[a : a + 512]
            i, j = np.nonzero(u32[r] @ c32 >= at_least - 1e-4)
            i, j = r[i], cols[j]
            i, j = i[i != j], j[i != j]
            cos = np.round(np.einsum("ij,ij->i", u[i], u[j]), 6)
            ok = cos >= at_least
            i, j, cos = i[ok], j[ok], cos[ok]
            out.append(best(ids, i, j, cos))
            found.append(best(ids, j, i, cos))
        return pd.concat(out + found) if out else pd.DataFrame({"id": [], "other": [], "cosine": []})

    met = spread.groupBy("leaf", "a", "b").applyInPandas(compare, "id bigint, other bigint, cosine double")
    ranked = _top(met, k)
    if crowded.isEmpty():
        return ranked
    # Copies beyond the indexed ones: the neighbours of the first copy, and that copy itself.
    ranked = materialise(ranked, "nearest")
    first = lead.where("place = 1").select("h1", "h2", F.col("id").alias("first"))
    twin = surplus.join(first, ["h1", "h2"]).select("id", "first")
    theirs = twin.join(ranked.select(F.col("id").alias("first"), "other", "cosine"), "first").select("id", "other", "cosine")
    own = twin.select("id", F.col("first").alias("other"), F.lit(1.0).alias("cosine"))
    return ranked.unionByName(_top(theirs.unionByName(own), k))


def _leaf_loads(shared):
    """How many rows of a task live in and visit each leaf."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown = Tree(*shared.value)
        homes, visits = np.zeros(len(grown.centres), dtype=np.int64), np.zeros(len(grown.centres), dtype=np.int64)
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                x, norm = _unit(pdf["vector"].iloc[a : a + 2000])
                _, leaf, rank = search(grown, (x / norm[:, None]).astype(np.float32))
                np.add.at(homes, leaf[rank == 0], 1)
                np.add.at(visits, leaf, 1)
        at = np.flatnonzero(visits)
        yield pd.DataFrame({"leaf": at.astype(np.int32), "homes": homes[at], "visits": visits[at]})

    return count


def _top(pairs: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return pairs.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
