"""Pointer jumping, paths and the sessions to drop, against plain Python."""

import random

from engrava.llm import conversations

MESSAGES = "id bigint, session_id string, role string, content string, timestamp double, hash string, extra string"


def naive(nodes):
    parent = dict(nodes)
    out = {}
    for i in parent:
        seen, at, steps, state = {i}, i, 0, "rooted"
        while parent[at] is not None:
            if parent[at] not in parent:
                state = "orphan"
                break
            at, steps = parent[at], steps + 1
            if at in seen:
                state = "cycle"
                break
            seen.add(at)
        out[i] = (None, None, "cycle") if state == "cycle" else (at, steps, state)
    return out


def test_resolve(spark):
    rng = random.Random(5)
    nodes = [(i, None if i % 40 == 1 else i - 1) for i in range(1, 200)]
    nodes += [(i, rng.choice([None, 300, i - 1, 9999])) for i in range(300, 340)]
    nodes += [(500, 501), (501, 502), (502, 500), (503, 500), (600, 600)]
    got = {r.id: (r.root, r.depth, r.state) for r in conversations.resolve(spark.createDataFrame(nodes, "id bigint, parent bigint")).collect()}
    assert got == naive(nodes)


def test_paths(spark):
    nodes = [(1, None), (2, 1), (3, 2), (4, 2), (5, 4), (6, 5), (7, 1), (10, None), (20, 21), (21, 20), (30, 99)]
    got = {}
    for r in conversations.paths(spark.createDataFrame(nodes, "id bigint, parent bigint")).collect():
        got.setdefault(r.leaf, []).append((r.position, r.id))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {3: [1, 2, 3], 6: [1, 2, 4, 5, 6], 7: [1, 7], 10: [10]}


def rows(sid, *turns):
    return [(sid, r, c, float(k)) for k, (r, c) in enumerate(turns)]


def test_sessions(spark):
    data = (
        rows("good", ("user", "q"), ("system", "s"), ("AI", "a"), ("bot", "b"), (" Human ", "q"), ("tool", "t"), ("model", "a"))
        + rows("unanswered", ("user", "q"), ("assistant", "a"), ("user", "q2"))
        + rows("double", ("user", "q"), ("user", "q2"), ("assistant", "a"))
        + rows("late", ("assistant", "a"), ("user", "q"), ("assistant", "a"))
        + rows("blank", ("user", "​ "), ("assistant", "a"))
        + rows("alone", ("user", "q"), ("?", "who"))
        + rows("empty", ("system", "s"))
        + rows(None, ("user", "q"))
    )
    table = spark.createDataFrame([(i, f" {s}" if s and i % 2 else s, r, c, t, f"{i:064x}", "x") for i, (s, r, c, t) in enumerate(data)], MESSAGES)
    got = {r.session_id: r.reason for r in conversations.judged_sessions(table).collect()}
    assert got == {"good": None, "unanswered": "unanswered", "double": "unanswered", "late": "late_user", "blank": "no_user", "alone": "no_assistant", "empty": "no_user"}
    turns = conversations.conversations(table).orderBy("position").collect()
    assert [t.content for t in turns] == ["q", "a", "b", "q", "a"] and {t.session_id for t in turns} == {"good"}


def test_empty_and_ties(spark):
    assert conversations.judged_sessions(spark.createDataFrame([], MESSAGES)).count() == 0
    tied = spark.createDataFrame([(2, "s", "assistant", "a" * 50000, None, "a" * 64, ""), (1, "s", "user", "q", None, "b" * 64, "")], MESSAGES)
    assert [r.dropped for r in conversations.judged_sessions(tied).collect()] == [False]


def test_a_session_over_many_partitions(spark):
    rng = random.Random(8)
    data = [(i, "hot", rng.choice(("user", "assistant")), "t", float(rng.randrange(300)), None, "") for i in range(900)] + [(1000 + i, f"s{i}", "user", "t", 1.0, None, "") for i in range(50)]
    table = spark.createDataFrame([(i, s, r, f"{c}{i}", t, f"{i:064x}", x) for i, s, r, c, t, _, x in data], MESSAGES)
    order = sorted((t, i) for i, s, _, _, t, _, _ in data if s == "hot")
    got = {r.id: (r.root, r.position, r.parent) for r in conversations.rebuild(table).where("sid = 'hot'").collect()}
    assert got == {i: (order[0][1], k, order[k - 1][1] if k else None) for k, (_, i) in enumerate(order)}
    cut = conversations.segments(conversations.link(conversations.kept_turns(table)))
    assert cut.where("sid = 'hot'").count() > 1 and cut.groupBy().sum("n").first()[0] == 950


def test_steps_count(spark):
    nodes = spark.createDataFrame([(1, None, None), (2, 1, 10), (3, 2, 5), (4, 9, 7)], "id bigint, parent bigint, step bigint")
    got = {r.id: (r.root, r.depth, r.state) for r in conversations.resolve(nodes).collect()}
    assert got == {1: (1, 0, "rooted"), 2: (1, 10, "rooted"), 3: (1, 15, "rooted"), 4: (4, 0, "orphan")}
