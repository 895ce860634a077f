"""Most similar vectors against brute force, with copies, ties and unusable vectors."""

import numpy as np

from engrava.llm import neighbours


def brute(ids, v, k, at_least):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    out = set()
    for a in range(len(u)):
        cos = np.round(u[a] @ u.T, 6)
        near = [j for j in np.flatnonzero(cos >= at_least) if j != a]
        for j in sorted(near, key=lambda j: (-cos[j], ids[j]))[:k]:
            out.add((ids[a], ids[j]))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(120, 16))
    v = np.repeat(centres, 15, axis=0) + 0.22 * rng.normal(size=(1800, 16))
    v = np.concatenate([v, np.repeat(centres[:1], 900, axis=0), centres[1:30] * 3.5]).astype(np.float32)
    ids = rng.permutation(len(v)).tolist()
    bad = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0] * 15), (5005, [float("inf")] + [1.0] * 15), (5006, [None] * 16)]
    rows = [(i, x.tolist(), "clash") for i, x in zip(ids, v, strict=True)] + [(i, x, "clash") for i, x in bad]
    table = spark.createDataFrame(rows, "id bigint, vector array<float>, other string")
    want = brute(ids, v.astype(np.float64), 5, 0.86)
    got = {(r.id, r.other) for r in neighbours.nearest(table, width=16, leaf_size=100, block=4000).collect()}
    assert len(want & got) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    tiled = {(r.id, r.other) for r in neighbours.nearest(table, width=16, leaf_size=100, block=37).collect()}
    assert tiled == got


def test_nothing(spark):
    table = spark.createDataFrame([], "id bigint, vector array<float>")
    assert neighbours.nearest(table).count() == 0
    alone = spark.createDataFrame([(1, [1.0] * 64), (2, [-1.0] * 64)], table.schema)
    assert neighbours.nearest(alone).count() == 0


def test_copies_take_no_leaves():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2000, 16))
    v = np.concatenate([np.repeat(v[:1], 1000, axis=0), v]).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    centres, children = neighbours.fit(v, 100, 8)
    leaves = [c for c, (a, b) in zip(centres, children, strict=True) if a == b]
    assert len(np.unique(np.round(leaves, 4), axis=0)) == len(leaves) >= 90
    # pairs of equal vectors alone say nothing about the recall
    assert neighbours.calibrate(centres, children, v[:1000], 0.86, 0.999, 16)[0] == 0.1


def test_tree_is_built_without_surplus_copies(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = np.concatenate([np.ones((300, 16)), rng.normal(size=(50, 16))])
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vector array<float>")
    seen, build = [], neighbours.build
    monkeypatch.setattr(neighbours, "build", lambda vectors, n, **kw: seen.append((vectors.count(), n)) or build(vectors, n, **kw))
    assert neighbours.nearest(table, width=16).where("id < 300").count() == 1500
    assert seen == [(56, 56)]


def test_visits_widen_until_the_recall_is_reached(spark):
    v = np.random.default_rng(6).normal(size=(2000, 4)).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vector array<float>")
    want = brute(list(range(len(v))), v.astype(np.float64), 5, 0.86)
    got = {(r.id, r.other) for r in neighbours.nearest(table, width=4, leaf_size=20, visits=1).collect()}
    assert len(want & got) >= 0.99 * len(want)


def test_recall_is_reached_in_few_dimensions(spark):
    rng = np.random.default_rng(9)
    v = (rng.normal(size=(3000, 3)) @ rng.normal(size=(3, 32)) + 0.02 * rng.normal(size=(3000, 32))).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vector array<float>")
    want = brute(list(range(len(v))), v.astype(np.float64), 5, 0.86)
    got = {(r.id, r.other) for r in neighbours.nearest(table, width=32, leaf_size=30, visits=2).collect()}
    assert len(want & got) >= 0.99 * len(want)
    cut = {(r.id, r.other) for r in neighbours.nearest(table, width=32, leaf_size=30, visits=2, block=50).collect()}
    assert cut == got
