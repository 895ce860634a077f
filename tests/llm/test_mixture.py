"""Mixtures: shares, caps, unreachable and absent sources."""

import random

from engrava.llm import mixture


def test_shares_and_caps(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta epsilon".split()
    rows, i = [], 0
    for source, n in (("big", 900), ("mid", 300), ("small", 60), ("tiny", 5), (None, 40), ("other", 50)):
        for _ in range(n):
            i += 1
            rows.append((i, source, " ".join(rng.choice(words) for _ in range(rng.randrange(20, 120))), "clash"))
    rows += [(9001, "big", None, ""), (9002, "big", "", "")]
    documents = spark.createDataFrame(rows, "doc_id bigint, source string, text string, tokens string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.4, 3), ("small", 0.1, 4), ("tiny", 0.05, 2), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    mixed = mixture.mix(documents, targets)
    got = {r.source: r for r in mixture.shares(mixed, targets).collect()}
    assert all(r.most_copies <= r.max_repeats for r in got.values())
    assert got["absent"].tokens == 0 and got["tiny"].n_documents == 5 and got["tiny"].most_copies == 2
    base = got["big"].tokens / 0.4
    assert abs(got["mid"].tokens / base - 0.4) < 0.01 and abs(got["small"].tokens / base - 0.1) < 0.01
    assert {r.source for r in mixed.select("source").distinct().collect()} == {"big", "mid", "small", "tiny"}


def test_nothing(spark):
    documents = spark.createDataFrame([], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixture.mix(documents, targets).count() == 0
    assert [r.actual_share for r in mixture.shares(mixture.mix(documents, targets), targets).collect()] == [0.0]
