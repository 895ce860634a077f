"""Leaked passages: whole, in pieces, changed, and below the share; winnowing's guarantee."""

import random

from engrava.llm import leakage

WORDS = [a + b for a in "ka lo mi nu pe ra so tu".split() for b in "bar den fil gos hum jat kel mur".split()]


def text(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)]


def test_shares(spark):
    rng = random.Random(3)
    item, other = text(rng, 60), text(rng, 60)
    changed = [w if i % 11 else "changed" for i, w in enumerate(item)]
    docs = {
        1: "**" + " ".join(item[:20]).upper() + "** " + " ".join(text(rng, 50)) + "\n- " + ", ".join(item[20:40]),
        2: " ".join(text(rng, 30) + changed + text(rng, 30)),
        3: " ".join(text(rng, 40) + item[:15] + text(rng, 40)),
        4: " ".join(text(rng, 4000) + item + text(rng, 4000)),
        5: " ".join(text(rng, 80)),
        6: "",
        7: None,
        8: "测试" + "检索服务谨慎地重建完整的检索结果而且看板清理了常用的向量" + "结束",
        9: " ".join(text(rng, 40) + item[30:] + text(rng, 5) + item[:30]),
    }
    items = [(1, " ".join(item), "x"), (2, " ".join(other), "x"), (3, "检索服务谨慎地重建完整的检索结果，而且看板清理了常用的向量。", "x"), (4, None, "x"), (5, "", "x")]
    d = spark.createDataFrame([(k, v, "clash") for k, v in docs.items()], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()}
    assert got == {(1, 1), (2, 1), (4, 1), (8, 3), (9, 1)}
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i, broadcast_rows=0).collect()} == got
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_every_long_shared_span_is_met():
    rng, known = random.Random(9), {}
    need = leakage.WORDS[0] + leakage.WORDS[1] - 1
    for _ in range(200):
        span = text(rng, need)
        a = leakage.fingerprints(text(rng, rng.randrange(9)) + span + text(rng, rng.randrange(9)), known)[0]
        b = leakage.fingerprints(text(rng, rng.randrange(9)) + span + text(rng, rng.randrange(9)), known)[0]
        assert set(a.tolist()) & set(b.tolist())


def test_short_items_are_found_whole(spark):
    d = spark.createDataFrame([(1, "We know: **Paris** is\ncapital of it."), (2, "paris is a capital"), (3, "sparis is capital"), (4, "数据库很好用吗"), (5, None)], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, "Paris is capital"), (2, "数据库很好"), (3, "..."), (4, None)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()} == {(1, 1), (4, 2)}
