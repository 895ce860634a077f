"""Ranking and fusion: ties, missing channels, packing that passes over, diversity, and the contract's names."""

import math

import __spark_entry__ as contract
from engrava.operators import retrieval
from engrava.plans import retrieval as plans
from pyspark.sql import functions as F


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 30, 1)], "qid bigint, id bigint, rank bigint")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "qid bigint, id bigint, rank bigint")
    got = {(r.qid, r.id): r.fused for r in retrieval.rank_fusion({"a": (a, 0.5), "b": (b, 0.5)}).collect()}
    assert math.isclose(got[1, 11], (0.5 / 62 + 0.5 / 61) / (1 / 61)) and math.isclose(got[2, 30], 1.0)
    fixed = {(r.qid, r.id): r.fused for r in retrieval.rank_fusion({"a": (a, 0.5), "b": (b, 0.5)}, fixed=True).collect()}
    assert math.isclose(fixed[2, 30], 0.5)


def test_pack_passes_over(spark):
    rows = spark.createDataFrame([(1, 1, 1, 80), (1, 2, 2, 4000), (1, 3, 3, 40), (2, 9, 1, 999999)], "qid bigint, id bigint, rank bigint, n_chars bigint")
    assert [(r.qid, r.position, r.id) for r in retrieval.pack(rows, 30).orderBy("qid", "position").collect()] == [(1, 0, 1), (1, 1, 3)]


def test_vector_topk_and_ties(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 4)] + [(7, [0.0, 1.0]), (8, [-1.0, 0.0])], "id bigint, vector array<double>")
    asked = spark.createDataFrame([(3, [2.0, 0.0])], "qid bigint, vector array<double>")
    got = [(r.id, round(r.score, 3), r.rank) for r in retrieval.vector_topk(asked, rows, 3).orderBy("rank").collect()]
    assert got == [(4, 1.0, 1), (5, 1.0, 2), (7, 0.5, 3)]
    assert retrieval.vector_topk(asked.limit(0), rows, 3).count() == 0


def test_terms_and_diversity(spark):
    got = spark.createDataFrame([("What is the Plan_B of 检索服务?",), ("",), (None,)], "c string").select(retrieval.terms(F.col("c")).alias("t")).collect()
    assert got[0].t == ["plan_b", "检索", "索服", "服务"] and got[1].t == [] and got[2].t is None
    pool = spark.createDataFrame([(1, 1, 1.0, "same words here"), (1, 2, 0.95, "same words here"), (1, 3, 0.8, "quite other text")], "qid bigint, id bigint, score double, text string")
    assert [r.id for r in retrieval.diverse(pool, 2, 0.5).orderBy("position").collect()] == [1, 3]


def test_diversity_pool(spark, monkeypatch):
    assert [retrieval.diversity_pool(k) for k in (1, 5, 10, 20)] == [20, 25, 50, 60]
    rows = [(1, i, 1 - i / 1000, "same words here" if i not in (24, 25) else "quite other text" if i == 24 else "zzzz yyyy") for i in range(30)]
    pool = spark.createDataFrame(rows, "qid bigint, id bigint, score double, text string")
    assert {0, 24} <= (got := {r.id for r in retrieval.diverse(pool, 5, 0.5).collect()}) and 25 not in got
    docs = pool.select("id", "text")
    monkeypatch.setattr(plans, "_documents", lambda *_: docs)
    monkeypatch.setattr(plans, "_questions", lambda *_: None)
    monkeypatch.setattr(retrieval, "bm25", lambda *_: pool.select("qid", "id", F.when(F.col("id") == 24, 0.976).otherwise(F.col("score")).alias("bm25")))
    assert 24 in {r.id for r in plans.q14_diverse(spark, "").collect()}


def test_contract():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40
