"""Store, gates, notes, sources and streaming on small fixtures."""

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from engrava.functions import notes, text
from engrava.operators import gates, store
from engrava.sources import files
from engrava.streaming import ingest


def test_tombstones(spark):
    long = "the retracted sentence is long enough to count as a prefix of another"
    facts = spark.createDataFrame([(1, "Gone  Fact", "x"), (2, long + " with more words", "x"), (3, "unrelated", "x"), (4, None, "x"), (5, "", "x"), (6, long[:45], "x"), (7, long[:30], "x")], "fact_id bigint, content string, fp string")
    stones = facts.where("fact_id = 1").select(text.fingerprint(F.col("content")).alias("fp"), F.lit(None).cast("string").alias("content_prefix")).unionByName(spark.createDataFrame([(None, long.upper()), (None, "short")], "fp string, content_prefix string"))
    assert {r.fact_id for r in store.tombstoned(facts, stones).collect()} == {1, 2, 6}
    assert store.tombstoned(facts.limit(0), stones).count() == 0


def test_capacity_and_newest(spark):
    facts = spark.createDataFrame([(i, "a" if i < 6 else None, f"2023-03-0{i}", f"t{i % 2}") for i in range(1, 9)], "fact_id bigint, agent string, timestamp string, content string")
    assert {r.fact_id for r in store.over_capacity(facts, 3).collect()} == {1, 2}
    assert {(r.fact_id, r.copies) for r in store.newest_by_content(facts).collect()} == {(7, 4), (8, 4)}


def test_index_difference(spark):
    a = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "path string, mtime double")
    b = spark.createDataFrame([("b", 9.0), ("c", 1.2), ("d", 1.0)], "path string, mtime double")
    assert {(r.path, r.state) for r in store.index_difference(a, b).collect()} == {("a", "missing"), ("b", "stale"), ("c", "current"), ("d", "orphaned")}


def test_gate(spark):
    cases = {"Is it so?": "question", "": "empty", "​": "empty", "abc": "short", "x" * 501: "long", "git push origin": "command", "Thanks!": "greeting", "We always deploy on Monday mornings.": None, "api_key = abcdef123": "credential", "笔记库每周一更新索引": None}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "c string").select("c", gates.rejection(F.col("c")).alias("r")).collect()
    assert {r.c: r.r for r in rows} == {**cases, None: "empty"}
    hidden = spark.createDataFrame([("token = abcdefgh and bearer abcdefghijklmnop1",)], "c string").select(gates.redacted(F.col("c")).alias("c")).first().c
    assert hidden == "token = [REDACTED] and bearer [REDACTED]"


def test_notes_and_vault(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    (tmp_path / ".dot").mkdir()
    note = "---\ntitle: Old plan\ntags: [a, b , a]\nstatus: draft\n---\n# Head\nSee [[notes/Other|alias]] and [[Third]].\n"
    (tmp_path / "inbox" / "one.md").write_text(note)
    (tmp_path / "inbox" / "index.md").write_text("x")
    (tmp_path / ".dot" / "two.md").write_text("x")
    r = files.read_vault(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0].section, r[0].title, r[0].status, r[0].tags, r[0].links) == ("inbox", "Old plan", "draft", ["a", "b"], ["Other", "Third"])
    plain = spark.createDataFrame([("# Only head\ntext",), ("",), (None,)], "t string").select(notes.title(F.col("t")).alias("t")).collect()
    assert [x.t for x in plain] == ["Only head", "", None]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id": 1, "c": "a"}\nbroken {\n\n{"id": 2, "c": null}\n')
    good, bad = files.read_json_lines(spark, str(path), StructType([StructField("id", LongType()), StructField("c", StringType())]))
    assert {(r.id, r.c) for r in good.collect()} == {(1, "a"), (2, None)} and [r.line for r in bad.collect()] == ["broken {"]


def test_streaming_ingest(spark, tmp_path):
    schema = "id bigint, session_id string, role string, content string, timestamp double, hash string"
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    first = [(1, "s", "user", "password: hunter22", 1.0, "a" * 64), (2, "s", "user", "again", 2.0, "a" * 64)]
    second = [(3, "s", "user", "late", 0.0, "a" * 64), (4, "s", "assistant", "new", 3.0, "b" * 64)]
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
        ingest.ingest(stream, table, str(tmp_path / "check")).awaitTermination()
    kept = {r.id: r.content for r in spark.read.parquet(table).collect()}
    assert kept == {1: "password: [REDACTED]", 4: "new"}
