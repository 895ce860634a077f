"""Message deduplication: spellings of one identifier, times in two units, ties, nulls, a hot message, batches."""

import hashlib

from engrava.operators import delivery

SCHEMA = "id bigint, session_id string, role string, content string, timestamp double, hash string, keep string"


def sha(*parts):
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def test_redelivered(spark):
    h = sha("s1", "user", "hello")
    rows = [
        (1, "s1", "user", "hello", 200.0, h, "x"),
        (2, " s1\t", "USER", "hello", 100.0, "sha256:" + h.upper(), "x"),
        (3, "s1", "Human", "hello", 1.6e12, None, "x"),
        (4, "s1", "user", "", None, h, "x"),
        (5, "s2", "user", "hello", 100.0, h, "x"),
        (6, None, "user", "hello", 1.0, h, "x"),
        (7, "  ", "user", "hello", 1.0, h, "x"),
        (8, "s3", "user", "tie", 5.0, "a" * 64, "x"),
        (9, "s3", "user", "tie", 5.0, "a" * 64, "x"),
        (10, "s4", "user", "late", None, "b" * 64, "x"),
        (11, "s4", "user", "late", float("nan"), "b" * 64, "x"),
        (12, "s5", "user", "ms", 1600000000.0, "c" * 64, "x"),
        (13, "s5", "user", "ms", 1599999999000.0, "c" * 64, "x"),
        (14, "s6", None, None, 1.0, None, None),
        (15, "s6", None, "z" * 100000, 1.0, None, None),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    assert {r.id for r in delivery.redelivered(table).collect()} == {1, 3, 4, 9, 11, 12}
    kept = delivery.deduplicate(table)
    assert kept.columns == table.columns and {r.id for r in kept.collect()} == {2, 5, 6, 7, 8, 10, 13, 14, 15}


def test_hot_message_and_batches(spark):
    rows = [(i, "s", "user", "hot", float(i), "d" * 64, "x") for i in range(500)] + [(1000 + i, "s", "user", str(i), 0.0, f"{i:064x}", "x") for i in range(50)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert delivery.redelivered(table).count() == 499
    batch = spark.createDataFrame([(5000, "s", "user", "hot", 0.0, "d" * 64, "x"), (5001, "s", "user", "new", 0.0, "e" * 64, "x"), (5002, "s", "user", "new", 1.0, "e" * 64, "x"), (5003, None, "user", "n", 0.0, "d" * 64, "x")], SCHEMA)
    assert {r.id for r in delivery.new_messages(batch, table).collect()} == {5001, 5003}


def test_empty(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert delivery.redelivered(table).count() == 0 and delivery.new_messages(table, table).count() == 0
