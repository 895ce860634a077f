"""Note search, routes, related and contained notes, eviction, links, evaluation entries, against plain Python and fixed cases."""

import random

import pytest
from pyspark.sql import functions as F

from engrava.functions import text
from engrava.operators import notes, retrieval
from engrava.session import materialise, scratch, shared_folder
from engrava.streaming import ingest


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


NOTE = "doc_id bigint, path string, text string, qid string"


def test_search(spark):
    rows = [(1, "a/x.md", "---\ntitle: Alpha v1.2.3 plan\ntags: [tool, alpha]\n---\nThe body of alpha.", "c"), (2, "b/y.md", "# Other\nhas v1.2.3 inside", "c"), (3, "b/z.md", "---\nstatus: Archived\n---\nalpha v1.2.3", "c"), (4, "b/e.md", "", "c"), (5, "b/n.md", None, "c"), (6, "b/l.md", "word " * 40000, "c")]
    read = notes.read_notes(table(spark, rows, NOTE))
    asked = table(spark, [(1, "alpha v1.2.3 plan"), (2, ""), (3, None), (4, "what is v1.2.3")], "qid bigint, text string")
    got = {(r.qid, r.id): r for r in notes.keyword(asked, notes.live(read)).collect()}
    assert got[1, 1].raw == 10.0 and got[1, 1].keyword == 1.0 and got[4, 2].exact == 0.72 and (1, 3) not in got and not any(q in (2, 3) for q, _ in got)
    second = table(spark, [(1, 2, 0.5), (1, 9, 1.0)], "qid bigint, id bigint, score double")
    fused = {(r.qid, r.id): r.score for r in notes.fuse(notes.keyword(asked, notes.live(read)), second).collect()}
    assert abs(fused[1, 1] - 0.4) < 1e-9 and abs(fused[1, 9] - 0.6) < 1e-9
    assert {(r.id, r.via) for r in notes.admit(table(spark, [(1, 1, 0.4, 0.9), (1, 2, 0.5, 0.0), (1, 3, 0.1, 0.1)], "qid bigint, id bigint, score double, keyword double"), 0.45, 0.35).collect()} == {(1, "keyword"), (2, "fused")}
    empty = read.limit(0)
    assert notes.keyword(asked, empty).count() == 0 and notes.keyword(asked.limit(0), read).count() == 0


def test_routes(spark):
    cases = {"open src/main.py": "exact", "which 笔记": "navigational", "你记得 what": "episodic", "how to": "conceptual", "plain": "general", "": "general", "see v2.10.7，ok": "exact", "关于v0.10.0，": "exact"}
    got = table(spark, [(k,) for k in cases] + [(None,)], "q string").select("q", notes.mode(F.col("q")).alias("m")).collect()
    assert {r.q: r.m for r in got} == {**cases, None: "general"}


def test_related_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.sample(["hot", "a", "b", "c", "d", "e"], rng.randrange(4)) + (["hot", "HOT "] if i % 3 else []), "x") for i in range(80)] + [(99, None, "x"), (100, [None, ""], "x")]
    got = {}
    for r in notes.related(table(spark, rows, "id bigint, tags array<string>, other string")).collect():
        got.setdefault(r.id, []).append((-r.shared, r.other, r.rank))
    sets = {i: {t.strip().lower() for t in ts or [] if t} for i, ts, _ in rows}
    for i, s in sets.items():
        best = sorted((-len(s & o), j) for j, o in sets.items() if j != i and s & o)[:5]
        assert sorted(got.get(i, [])) == [(n, j, k + 1) for k, (n, j) in enumerate(best)]
    with pytest.raises(Exception, match="more than"):
        notes.related(table(spark, [(1, [str(i) for i in range(20)])], "id bigint, tags array<string>")).collect()


def test_contained(spark):
    rng = random.Random(2)
    words = ["w" + str(rng.randrange(500)) for _ in range(400)]
    whole = " ".join(words)
    rows = [(1, whole), (2, " ".join(words[50:120])), (3, whole.upper() + "  "), (4, " ".join(words[:20]) + " changed " + " ".join(words[20:60])), (5, "short"), (6, None), (7, "x" * 90), (8, "x" * 5000)]
    assert {(r.id, r.within) for r in notes.contained(table(spark, rows, "id bigint, body string")).collect()} == {(2, 1), (3, 1), (7, 8)}


def test_contained_by_the_rarest_mark(spark):
    rng = random.Random(8)
    head = " ".join("h" + str(rng.randrange(500)) for _ in range(40))
    own = [" ".join(f"n{i}x{rng.randrange(900)}" for _ in range(20)) for i in range(60)]
    rows = [(i, f"{head} {t}") for i, t in enumerate(own)] + [(100 + i, f"before {head} {t} after") for i, t in enumerate(own[:5])] + [(200, f"{head} {own[0]}"), (300, head)]
    notes_ = table(spark, rows, "id bigint, body string")
    marks = table(spark, [(i, m) for i, t in rows[:65] for m in notes._marks_of(t).tolist()], "id bigint, mark bigint")
    # notes that share a beginning don't meet through it
    met = {(r.a, r.b) for r in notes._within(marks, 2).collect()}
    assert {(i, 100 + i) for i in range(5)} <= met and all(abs(a - b) == 100 for a, b in met)
    got = {(r.id, r.within) for r in notes.contained(notes_).collect()}
    assert got == {(i, 100 + i) for i in range(5)} | {(200, 0)} | {(300, i) for i in [*range(60), *range(100, 105)]}


def test_evicted_needs_use(spark):
    facts = table(spark, [(i, "a" if i < 6 else None, f"2023-0{i}") for i in range(1, 9)], "fact_id bigint, agent string, timestamp string")
    used = table(spark, [(1, 9), (2, 5)], "key bigint, last_used bigint")
    assert {r.fact_id for r in notes.evicted(facts, used, 3).collect()} == {3, 4}
    assert notes.evicted(facts, used.limit(0), 3).count() == 0


def test_links_and_gold(spark):
    told = table(spark, [(1, "A", "Title A", ["also a"], [], None), (2, "b", None, None, ["idea"], "draft"), (3, "c", "C", [], [], "archived"), (4, "lone", "L", [], [], None)], "id bigint, stem string, title string, aliases array<string>, concepts array<string>, status string")
    links = table(spark, [(1, "B"), (1, "Idea"), (2, "ALSO A"), (2, "nowhere"), (3, "lone")], "id bigint, target string")
    assert {r.kind: r.n for r in notes.link_audit(told, links).collect()} == {"note": 2, "concept": 1, "unknown": 1, "orphan": 1}
    gold = [(1, "dev", 0, "What is 10.0.0.1 today?", "t"), (2, "held", 1, "what is ！", "t"), (3, "dev", 0, "b", "t"), (4, "dev", 0, "c", "t"), (5, "dev", 0, None, "t"), (6, "held", 1, "d", "t")]
    got = {r["item"]: r.reason for r in notes.gold_kept(table(spark, gold, "item bigint, part string, priority int, query string, title string")).collect()}
    assert got == {1: "kept", 2: "kept", 3: "kept", 4: "title_cap", 5: "empty", 6: "kept"}


def test_sentences_and_pages(spark):
    c = "Version 3.14 is out. See https://x.org/a for it! 好的。再见；Is it so? 10 more\n\nlast"
    page = "<html><script>x()</script><p>One &amp; two</p><div>Three</div></html>"
    r = table(spark, [(c, page)], "c string, p string").select(text.sentences(F.col("c")).alias("s"), text.html_text(F.col("p")).alias("p")).first()
    assert r.s == ["Version 3.14 is out", "See https://x.org/a for it", "好的", "再见", "Is it so?", "10 more", "last"] and r.p == "One & two\n\nThree"


def test_lexical_and_rescue(spark):
    texts = table(spark, [(1, "Der Zähler für Bäume zählt"), (2, "数据同步到服务器"), (3, "für"), (4, None), (5, "")], "id bigint, text string")
    asked = table(spark, [(1, "Zähler für Bäume"), (2, "同步数据"), (3, ""), (4, None)], "qid bigint, text string")
    got = {(r.qid, r.id): round(r.score, 3) for r in retrieval.lexical(asked, texts).collect()}
    assert got == {(1, 1): 1.0, (1, 3): 0.333, (2, 2): 0.667}
    assert {(r.qid, r.id) for r in retrieval.bm25(asked, texts).collect()} == {(1, 1), (1, 3), (2, 2)}
    hits = table(spark, [(1, 3, 1)], "qid bigint, id bigint, rank bigint")
    assert [(r.id, r.rank, r.rescued) for r in retrieval.rescue(hits, retrieval.lexical(asked, texts), 5).orderBy("rank").collect()] == [(3, 1, False), (1, 2, True)]


def test_containing_by_either_way(spark):
    texts = table(spark, [(1, "abcabc 数据"), (2, ""), (3, None), (4, "ab")], "id bigint, text string")
    parts = table(spark, [("abc",), ("a",), ("数据",), ("",), (None,), ("abcabc 数据x",)], "part string")
    want = {(1, "abc", 2), (1, "a", 2), (1, "数据", 1), (4, "a", 1)}
    for most in (100, 0):
        assert {tuple(r) for r in retrieval.containing(texts, parts, most).collect()} == want


def test_covering_needs_half_of_the_terms(spark):
    texts = table(spark, [(1, "alpha beta  GAMMA"), (2, "delta alpha"), (3, None), (4, "alpha beta gamma delta epsilon zeta")], "id bigint, text string")
    wanted = table(spark, [(1, "alpha beta gamma delta"), (2, ""), (3, None), (4, "zz")], "qid bigint, text string")
    for block in (10, 1):
        assert {tuple(r) for r in retrieval.covering(texts, wanted, block).collect()} == {(1, 1), (1, 2), (1, 4)}


def test_bm25_plan_shuffles_no_postings(spark):
    texts, asked = table(spark, [(1, "a1 b2")], "id bigint, text string"), table(spark, [("b2",)], "term string")
    seen = []
    write = retrieval.materialise
    retrieval.materialise = lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df
    try:
        retrieval.matches(asked, texts)
    finally:
        retrieval.materialise = write
    assert "Exchange hashpartitioning(id" not in seen[0] and "NestedLoop" not in seen[0]


def test_scratch_deletes_and_folder_is_named(spark, tmp_path):
    with scratch(spark):
        kept = materialise(spark.range(3))
        assert kept.count() == 3
        path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    from pathlib import Path

    assert not Path(path).exists() and shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_usage_counters(spark, tmp_path):
    schema = "key string, at bigint"
    for n, rows in enumerate(([("a", 1), ("a", 5), ("b", 2)], [("a", 3), (None, 9)])):
        table(spark, rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        ingest.usage_counters(stream, "key", "at", str(tmp_path / "use"), str(tmp_path / "check")).awaitTermination()
    assert {(r.key, r.hits, r.last_used) for r in ingest.current_usage(spark, str(tmp_path / "use")).collect()} == {("a", 3, 5), ("b", 1, 2)}
