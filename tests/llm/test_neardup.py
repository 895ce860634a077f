"""Near duplicates against brute force, copies, groups, and the estimate behind the bands."""

import random

import numpy as np
from pyspark.sql import functions as F

from engrava.llm import neardup, neardup_queries

WORDS = [a + b for a in "ka lo mi nu pe ra so tu vi zo".split() for b in "bar den fil gos hum jat kel mur nop rit".split()]


def corpus():
    rng = random.Random(11)
    texts = [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(60)]
    out = []
    for t in texts:
        out.append(t)
        w = t.split()
        for edits in (1, 3, 8):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = rng.choice(WORDS)
            out.append(" ".join(v))
    return out + texts[:5] * 2


def grams(t):
    return {t[i : i + 5] for i in range(len(t) - 4)}


def test_pairs_against_brute_force(spark):
    texts = corpus()
    rows = [("t", i, t.upper() + "  ", "clash") for i, t in enumerate(texts)] + [("t", 900, None, ""), ("t", 901, "", ""), ("t", 902, "short", "")] + [("u", 903, texts[0], ""), ("t", 904, "x" * 200000, "")]
    table = spark.createDataFrame(rows, "tbl string, id bigint, content string, text string")
    reps, members = neardup.representatives(neardup.prepared(table, F.col("content"), 80))
    links = neardup.pairs(reps, kind="chars", size=5, at_least=0.6, weighted=False)
    got = {(r.tbl, r.id_a, r.id_b) for r in neardup.expand(links, members).collect()}
    sets = [grams(t) for t in texts]
    want = {("t", i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert got <= want and len(got) >= 0.98 * len(want)
    grouped = neardup.groups(links, reps).where("tbl = 't'").collect()
    assert len(grouped) == len(set(texts)) + 1 and {r.group for r in grouped if r.rep < 4} == {0}


def test_samples_estimate_weighted_jaccard():
    a, b = "the quick brown fox jumps over the lazy dog by the river", "the quick brown fox leaps over the lazy dog by the river"
    df = np.ones(neardup.BUCKETS, dtype=np.int64)
    sig, _ = neardup.signatures([a, b], "chars", 5, df, 100, 2000)
    want = neardup.similarity(a, b, "chars", 5, df, 100)
    assert abs(float((sig[0] == sig[1]).mean()) - want) < 0.05


def test_nothing(spark):
    reps, members = neardup.representatives(spark.createDataFrame([], "tbl string, id bigint, text string"))
    links = neardup.pairs(reps)
    assert links.count() == 0 and neardup.expand(links, members).count() == 0 and neardup.groups(links, reps).count() == 0


def test_bands_follow_the_threshold():
    assert neardup.banding(0.8) == (24, 5)
    for at_least in (0.05, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0):
        bands, rows = neardup.banding(at_least)
        assert (1 - at_least**rows) ** bands <= 1.01e-4


def test_borderline_pairs_meet(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for i in range(400):
        w = [rng.choice(WORDS) for _ in range(40)]
        v = list(w)
        for at in rng.sample(range(40), 8):
            v[at] = rng.choice(WORDS)
        a, b = " ".join(w), " ".join(v)
        if 0.6 <= len(grams(a) & grams(b)) / len(grams(a) | grams(b)) < 0.7:
            want.add((2 * i, 2 * i + 1))
        rows += [("t", 2 * i, a), ("t", 2 * i + 1, b)]
    links = neardup.pairs(spark.createDataFrame(rows, "tbl string, rep bigint, text string"), kind="chars", size=5, at_least=0.6, weighted=False)
    assert len(want) > 100 and len(want & {(r.a, r.b) for r in links.collect()}) >= 0.99 * len(want)


def test_groups_place_every_record(spark, tmp_path):
    base = " ".join(WORDS[:60])
    near = base.replace(WORDS[59], "other")
    spark.createDataFrame([(1, base), (2, near), (3, base.upper()), (4, "alone")], "fact_id bigint, content string").write.parquet(str(tmp_path / "facts.parquet"))
    spark.createDataFrame([(1, near, "s"), (5, base, None), (6, near, "s"), (7, None, "s"), (8, "alone", "s")], "id bigint, content string, session_id string").write.parquet(str(tmp_path / "messages.parquet"))
    got = {(r.tbl, r.id): r.group for r in neardup_queries.p4_groups(spark, str(tmp_path)).collect()}
    assert got == {("facts", 1): 1, ("facts", 2): 1, ("facts", 3): 1, ("facts", 4): 4, ("messages", 1): 1, ("messages", 5): 1, ("messages", 6): 1, ("messages", 8): 8}


def test_weighted_pairs_against_brute_force(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(40):
        w = [rng.choice(WORDS) + rng.choice("xyz") for _ in range(150)]
        texts.append(" ".join(w))
        for edits in (1, 2, 4, 7):
            v = list(w)
            for _ in range(edits):
                at = rng.randrange(len(v))
                v[at : at + rng.randrange(2)] = [rng.choice(WORDS)]
            texts.append(" ".join(v))
    texts.append("same words again " * 3000)
    texts.append("same words again " * 2500)
    reps = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "tbl string, rep bigint, text string")
    df = neardup.document_frequencies(reps, "words", 5)
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (i // 5 == j // 5 or j >= 200) and neardup.similarity(texts[i], texts[j], "words", 5, df, len(texts)) >= 0.8}
    got = {(r.a, r.b) for r in neardup.pairs(reps).collect()}
    assert len(want) > 80 and (200, 201) in want and got <= want and len(got) >= 0.99 * len(want)
    assert {(r.a, r.b) for r in neardup.pairs(reps, waves=1).collect()} == got


def test_sketches_rule_out_and_lose_nothing(spark):
    rng = random.Random(31)
    texts = corpus() + [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (9, 12, 200, 400)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    reps = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "tbl string, rep bigint, text string")
    met = spark.createDataFrame([(0, i, j) for i, j in pairs], "code int, a bigint, b bigint")
    near = {(r.a, r.b) for r in neardup._near(met, neardup._sketches(reps, ["t"], "chars", 5), 0.6, [F.col("a") % 2 == 0, F.col("a") % 2 == 1]).collect()}
    sets = [grams(t) for t in texts]
    want = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert len(want) > 100 and want <= near and len(near) < 2 * len(want) < len(pairs) / 10


def test_a_pair_at_the_threshold_meets_with_its_set_jaccard():
    rng = random.Random(41)
    texts, want = [], []
    for n in (90, 160, 500, 900):
        for _ in range(40):
            # typing errors make rare runs of characters: weighted samples see far less than the sets have in common
            a = " ".join(rng.choice(WORDS) for _ in range(n // 4))[:n]
            b = "".join(rng.choice("0123456789") if i % 19 == 9 else c for i, c in enumerate(a))
            texts += [a, b]
            want.append(len(grams(a) & grams(b)) / len(grams(a) | grams(b)))
    owner, shingle, _ = neardup.shingles(texts, "chars", 5)
    got = neardup.samples(owner, shingle, len(texts), 268)
    agree = (got[::2] == got[1::2]).mean(axis=1)
    assert abs((agree - np.array(want)).mean()) < 0.01 and np.abs(agree - np.array(want)).max() < 0.15
    alone = [neardup.samples(*neardup.shingles([t], "chars", 5)[:2], 1, 268)[0] for t in texts[:6] + texts[-6:]]
    assert (np.array(alone) == got[[0, 1, 2, 3, 4, 5, -6, -5, -4, -3, -2, -1]]).all()


def test_what_stays_in_the_band_is_ruled_out_rightly():
    rng = random.Random(51)
    texts = []
    for n in (20, 60, 95, 110, 230, 500):
        for _ in range(30):
            w = [rng.choice(WORDS) + rng.choice("abc") for _ in range(n)]
            v = list(w)
            for at in rng.sample(range(n), round(n * rng.choice((0.05, 0.1, 0.15)))):
                v[at] = rng.choice(WORDS)
            texts += [" ".join(w), " ".join(v), " ".join(v + w[: n // 4])]
    owner, shingle, _ = neardup.shingles(texts, "chars", 5)
    sizes = np.bincount(owner, minlength=len(texts))
    sketches = neardup._parities(owner, shingle, sizes)
    entries, back = neardup._unpacked(neardup._packed(np.zeros(3, neardup._ENTRY), sketches))
    assert len(entries) == 3 and all((a == b).all() for a, b in zip(sketches, back, strict=True))
    width, place = neardup._width(sizes), np.zeros(len(texts), dtype=np.int64)
    for words in np.unique(width):
        place[width == words] = np.arange((width == words).sum())
    x, y = (np.array(c) for c in zip(*[(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if min(sizes[i], sizes[j]) >= 0.6 * max(sizes[i], sizes[j])], strict=True))
    close = neardup._close(x, y, sizes, width, place, sketches, 0.6)
    sets = [grams(t) for t in texts]
    jaccard = np.array([len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in zip(x, y, strict=True)])
    similar = jaccard >= 0.6
    assert len(np.unique(width)) >= 3 and (width[x] != width[y])[similar].any() and similar.sum() > 100
    assert close[similar].all() and (jaccard < 0.3).sum() > 1000 and close[jaccard < 0.3].mean() < 0.05


def test_bands_leave_few_pairs_and_little_to_shuffle(spark):
    reps = spark.createDataFrame([("t", i, t) for i, t in enumerate(dict.fromkeys(corpus()))] + [("u", 999, corpus()[0])], "tbl string, rep bigint, text string")
    dealt = [range(0, 67, 2), range(1, 67, 2)]
    signed = neardup._signed(reps, ["t", "u"], dealt, 4, "chars", 5, None, 240)
    met = [neardup._met(signed.select("head", f"w{i}"), len(own), 240, 0.6) for i, own in enumerate(dealt)]
    texts = {r.rep: grams(r.text) for r in reps.collect()}
    got = {(r.code, r.a, r.b) for one in met for r in one.collect()}
    want = {(0, i, j) for i in texts for j in texts if i < j < 999 and len(texts[i] & texts[j]) >= 0.6 * len(texts[i] | texts[j])}
    assert want <= got and len(got) < 1.5 * len(want)
    # an equi-join in packed parts: one exchange, and no join of single rows
    plan = met[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange ") == 1 and "Join" not in plan
