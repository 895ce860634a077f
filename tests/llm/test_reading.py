"""Reading levels on documents of known difficulty, held-out."""

import random

from engrava.llm import reading


def test_held_out_levels(spark):
    rng = random.Random(4)
    pools = [[f"{chr(97 + lv)}word{k}" + "x" * lv * 2 for k in range(60)] for lv in range(5)]
    rows, labels, truth = [], [], {}
    for i in range(600):
        level = 1 + i % 5
        pick = lambda lv=level: rng.choice(pools[min(4, max(0, lv - 1 + rng.choice((-1, 0, 0, 1))))])
        rows.append((i, ". ".join(" ".join(pick() for _ in range(3 + 3 * level)) for _ in range(6)), "clash"))
        truth[i] = level
        if i < 60:
            labels += [(i, level), (i, None)]
    rows += [(1000, None, ""), (1001, "", ""), (1002, "word " * 100000, "")]
    out = reading.levels(spark.createDataFrame(rows, "doc_id bigint, text string, label string"), spark.createDataFrame([*labels, (5555, 3)], "doc_id bigint, level int"))
    got = {r.doc_id: r.level for r in out.collect()}
    assert len(got) == 603 and all(1 <= v <= 5 for v in got.values())
    assert sum(abs(got[i] - truth[i]) for i in range(60, 600)) / 540 < 0.6


def test_nothing(spark):
    documents = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, level int")
    assert reading.levels(documents, labels).count() == 0
    one = spark.createDataFrame([(1, "plain text")], documents.schema)
    assert [r.level for r in reading.levels(one, labels).collect()] == [3.0]
