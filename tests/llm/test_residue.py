"""Residue: sure cases, records that only talk about them, and corpus evidence."""

import pytest
from pyspark.sql import functions as F

from engrava.llm import residue, residue_queries

SCHEMA = "rec_id string, host string, address string, title string, content string, extra int"

RESIDUE = {
    "template": ["Dear {{name}}, thank you for contacting {{company}} about {{topic}}.", "会议主题：${title}，结论：${result}", "# «LINK» ## BACKGROUND «SUMMARY» ## OUTCOME «DEADLINE»", "TODO: replace __user__ before publishing"],
    "filler": ["Lorem ipsum dolor sit amet consectetur elit sed do", "xxxxxxxxxxxx", "示例文本示例文本示例文本", "foo bar foo bar foo bar foo bar foo bar", "kgshk wqjaj skg kggwqg", "word " * 20000],
    "error": ["504 Gateway Time-out. Please try again later. Ref 1ae52694", "<noscript>Please enable JavaScript to continue</noscript>", "Zugriff verweigert", "页面不存在", "ACCESS DENIED REQUEST 16506A01B4", "您的浏览器未开启脚本功能，无法显示内容"],
}
REAL = [
    None, "", "   ", "​", "Done.", "已保存。", "ok",
    "I fixed the 404 on the login page by adding the route.",
    "The prompt builder swaps {{slot}} markers for the caller's value, and that part works.",
    "The test for 'Something went wrong' now passes.",
    "With scripts off, the page still shows the table of contents.",
    "昨天的 502 错误是网关重启造成的。",
    "The long report says what we did on day one, two and three of the move. " * 2000,
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"{k}{i}", "h", "a", None, t, 1) for k, ts in RESIDUE.items() for i, t in enumerate(ts)] + [(f"real{i}", "h", "a", None, t, 1) for i, t in enumerate(REAL)]
    return {r.rec_id: r.kind for r in residue.residue(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_kinds(found):
    assert found == {f"{k}{i}": k for k, ts in RESIDUE.items() for i in range(len(ts))}


def test_repeated_wording_from_many_hosts(spark):
    odd = "Access denied by gremlin zone policy seven. Please try again later."
    rows = [(f"r{i}", f"host{i}", f"slug{i}", None, odd, 1) for i in range(5)] + [("lone", "h", "s", None, "Access denied at purple bridge nine. Please try again later.", 1)]
    got = {r.rec_id for r in residue.residue(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {f"r{i}" for i in range(5)}


def test_exclusion_keeps_columns_and_rows(spark):
    rows = [("a", "h", "s", None, "Access denied", 1), ("b", "h", "s", None, "We met on Monday to plan the move.", 2), ("b2", "h", "s", None, None, 3)]
    kept = residue.exclude_residue(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["rec_id", "host", "address", "title", "content", "extra"]
    assert {r.rec_id for r in kept.collect()} == {"b", "b2"}


def test_empty_table(spark):
    assert residue.residue(spark.createDataFrame([], SCHEMA)).count() == 0


LONG = {
    "filler": ["The quick system works fine. " * 100, "The quick system works fine. " * 3000, "示例文本内容待补充" * 100, "示例文本内容待补充" * 6000, "测试测试测试" * 900, "x" * 50000, "asdf" * 4000, "foo bar " * 20000 + "foo"],
    None: ["no no no", "ok ok", "He said that that was all.", "数据 一 二 三 四 五 六 七 八 九 十 一 二 三", "".join(f"line {i} was read by reader {i * 7}. " for i in range(3000))],
}


def test_repetition_is_found_at_every_length(spark):
    rows = [(f"{k}{i}", "h", None, None, t, 1) for k, ts in LONG.items() for i, t in enumerate(ts)]
    got = {r.rec_id: r.kind for r in residue.residue(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {f"filler{i}": "filler" for i in range(len(LONG["filler"]))}


def test_corpus_decides_by_shared_wording_hosts_and_address(spark):
    page = "Something went wrong while the gremlin council of zone seven was counting its lamps."
    real = "Something went wrong in the report, so the gremlin council of zone seven asked Maria for the older figures of March."
    rows = [(f"p{i}", f"host{i}", "a-b", None, f"{page} Ref 1ae5269{i}", 1) for i in range(4)]
    rows += [("slug", "host9", "gremlin-council", None, page, 1), ("titled", "host9", "x", "The gremlin council", page, 1), ("own", "host8", "x", page[:20], page, 1), ("real", "host7", "x", None, real, 1)]
    got = {r.rec_id: r.decided_by for r in residue.evidence(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{f"p{i}": "corpus" for i in range(4)}, "own": "corpus"}
    one_host = [(f"p{i}", "host", "a-b", None, page, 1) for i in range(9)]
    assert residue.evidence(spark.createDataFrame(one_host, SCHEMA)).count() == 0
    # wording that mostly stands in other texts is no response's
    common = [(f"c{i}", f"host{i}", "a-b", None, page.replace("Something went wrong while", "Yesterday"), 1) for i in range(9)]
    assert residue.evidence(spark.createDataFrame(rows[:4] + common, SCHEMA)).count() == 0


def test_asked_records_are_judged_as_in_the_whole_corpus(spark):
    records = residue_queries.records(spark, "/root/testdata/sf0.001")
    some = records.where("rec_id LIKE 'messages|%' AND pmod(xxhash64(rec_id), 2) = 0").select(F.substring_index("rec_id", "|", -1).cast("bigint").alias("id"))
    ids = {f"messages|{r.id}" for r in some.collect()}
    whole = {(r.rec_id, r.kind) for r in residue.residue(records).collect() if r.rec_id in ids}
    got = {(r.rec_id, r.kind) for r in residue.residue(residue_queries.records(spark, "/root/testdata/sf0.001", some)).collect() if r.rec_id in ids}
    assert got == whole and whole
