"""Dates, volumes, author lines and suggestions: rows worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import metadata as md


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_spans(spark):
    assert [tuple(s) for s in one(spark, md.spans(F.lit("1a22bb\n333"), "[0-9]+"))] == [(0, 1, "1"), (2, 4, "22"), (7, 10, "333")]
    assert one(spark, md.spans(F.lit(None).cast("string"), "x")) == [] and one(spark, md.spans(F.lit("abc"), "x")) == []


@pytest.mark.parametrize(("text", "want"), [
    ("收稿日期: 2025-04-14  网络首发日期: 2025-08-21", [("2025-08-21", "online_first"), ("2025-04-14", "submitted")]),
    ("Vol. 37, No. 4, Dec. 2025 10.1234/j.abcd.2025.11 CN 11-6037/Z", [("2025-12", "published")]),
    ("Received 29 March 2025; 2025 年 12 月", [("2025-12", "published"), ("2025-03", "submitted"), ("2025-03-29", "submitted")]),
    ("https://doi.org/10.1/x.2024.05 ISSN 2024-11 2024/13/01 2001.5.6 1999-2-32", [("1999-02", "published"), ("2001-05-06", "published")]),
    ("Available online 2 Jan. 2020; June 2020 and 2020-06", [("2020-06", "published"), ("2020-01", "online_first"), ("2020-01-02", "online_first")]),
    ("ISSN 2019-01 x; No. 2018-02 but 2017-03", [("2017-03", "published")]),
    ("accepted, and much later than twenty characters 2016-05", [("2016-05", "published")]),
    ("投稿 2015年3月4日，上线 2015年3月4日", [("2015-03-04", "online_first")]),
    ("x2014-05 and 3014-05 and 2014", []), ("", []), (None, []),
])
def test_date_candidates(spark, text, want):
    assert [(c.value, c.kind) for c in one(spark, md.date_candidates(F.lit(text).cast("string")))] == want


def test_best_date_gives_its_own_characters(spark):
    assert tuple(one(spark, md.best_date(F.lit("on Dec. 2025, or so")))) == ("2025-12", "published", "Dec. 2025")
    assert one(spark, md.best_date(F.lit("never"))) is None


@pytest.mark.parametrize(("text", "want"), [
    ("第 14 卷 第 1 期 共 3 页", ("14", "1", None)), ("Vol. 37, No. 4 pp. 765-770", ("37", "4", "765-770")), ("37(4): 765-770", ("37", "4", "765-770")),
    ("2025, 42( 4) :68~83", ("42", "4", "68-83")), ("文章编号:1673-1379(2024)03-0296-05", (None, "3", "296-300")), ("文章编号:1673-1379(2024)03-0296-05 37(4): 1-2", ("37", "4", "1-2")),
    ("第14卷 第 3-9 页", ("14", None, "3-9")), ("Vol. 12345 of", (None, None, None)), ("Issue 7, page 3—4", (None, "7", "3-4")), ("第 2 卷 and Vol. 9, 8(7): 5-6", ("2", "7", "5-6")), (None, (None, None, None)),
])
def test_volume_issue_pages(spark, text, want):
    assert tuple(one(spark, md.volume_issue_pages(F.lit(text).cast("string"))))[:3] == want


@pytest.mark.parametrize(("line", "want"), [
    ("张三1, 李四2*, 王五等", (["张三", "李四", "王五"], True, True)), ("San Zhang1, Wei Wang2 and J. R. Smith*", (["San Zhang", "Wei Wang", "J. R. Smith"], False, True)),
    ("张三1, 李四2（某某大学）", (["张三", "李四"], False, True)), ("A. Lee, B. Ray, and C. Day", (["A. Lee", "B. Ray", "C. Day"], False, False)), ("Anderson Band & Ann O'Neil et al.", (["Anderson Band", "Ann O'Neil"], True, False)),
    ("某某大学 张三", None), ("the quick, brown fox", None), ("张三, 12 页", None), ("（只有括号）", None), ("one two three four", None), ("张三；" * 16, None), ("", None), (None, None),
])
def test_line_names(spark, line, want):
    got = one(spark, md.line_names(F.lit(line).cast("string")))
    assert (tuple(got) if got else None) == want


def test_creators(spark):
    heads = [
        (1, "A Study of Things\nSan Zhang1, Wei Wang2 et al.\n某某研究\n张三1, 李四2"), (2, "Thesis Title here\nby\nSan Zhang"), (3, "标题\n张三"), (4, "作者姓名: 张三\n作者简介: 李四"),
        (5, "张三丰研究, 李四研究\n王五1, 赵六2"), (6, "\n" * 29 + "张三1, 李四2\n"), (7, "\n" * 30 + "张三1, 李四2\n"), (8, "Zhang San, Li Si"), (9, None), (10, "Title of it\nZhang San, Li Si"), (11, "English Title\nAnn Lee, Bob Ray\n中文标题很长啊\n李安, 雷博"),
    ]
    titles = spark.createDataFrame([(5, "张三丰研究")], "k int, title string")
    got = {r.k: ([tuple(c) for c in r.creators], r.partial, r.labeled) for r in md.creators(spark.createDataFrame(heads, "k int, head string"), "k", titles).collect()}
    zhang, wang = ("Zhang", "San"), ("Wang", "Wei")
    # the English line of 1 has 6 points, the Chinese one 4 and 2 for its language: the earlier of equals
    assert got[1] == ([zhang, wang], True, False) and got[2] == ([zhang], False, True) and got[4] == ([("张三", "")], False, True)
    assert got[5] == ([("王五", ""), ("赵六", "")], False, False) and got[6][0] == [("张三", ""), ("李四", "")]
    assert got[10][0] == [("San", "Zhang"), ("Si", "Li")] and got[11][0] == [("李安", ""), ("雷博", "")]
    assert not {3, 7, 8, 9} & set(got)


FILL = " nothing but words of prose" * 10
ITEM = "item_key int, title string, date string, DOI string, volume string, issue string, pages string, creators string"


def test_suggest(spark):
    items = spark.createDataFrame([(1, "T", None, None, None, None, None, None), (2, "T", "1999", "10.1/x", " ", "4", "1-2", "someone"), (3, "T", None, None, None, None, None, None), (4, None, "", "", "", "", "", "")], ITEM)
    page = "item_key int, page int, text string"
    a = spark.createDataFrame([(1, 1, "The Title\n张三1, 李四2\nVol. 3, No. 2, Dec. 2020\ndoi: 10.1234/abc.5\npp. 4-9" + FILL), (2, 1, "Vol. 8" + FILL), (3, 1, "Vol. 9"), (1, 3, "Vol. 99")], page)
    b = spark.createDataFrame([(1, 1, "The Title\n张三1, 李四2, 王五3\nVol. 3, No. 5, Dec. 2020\npp. 4~9" + FILL), (2, 1, "Vol. 7" + FILL)], page)
    answers = spark.createDataFrame([(1, "issue", "5"), (3, "date", "2001"), (1, "volume", "77"), (2, "date", "2000")], "item_key int, field string, value string")
    got = {(r.item_key, r.field): r for r in md.suggest(items, a, b).collect()}
    plain = {k: (r.value, r.source, r.state, r.confidence, r.other) for k, r in got.items()}
    assert plain == {
        (1, "volume"): ("3", "a", "both", "high", None), (1, "issue"): ("2", "a", "conflict", "medium", "5"), (1, "pages"): ("4-9", "a", "both", "high", None), (1, "date"): ("2020-12", "a", "both", "high", None),
        (1, "DOI"): ("10.1234/abc.5", "a", "single", "high", None), (1, "creators"): ("张三; 李四; 王五", "b", "conflict", "medium", "张三; 李四"), (2, "volume"): ("8", "a", "conflict", "medium", "7"),
    }
    assert "No. 2" in got[1, "issue"].evidence and "王五3" in got[1, "creators"].evidence and got[1, "date"].kind == "published" and "Dec. 2020" in got[1, "date"].evidence
    asked = {(r.item_key, r.field): (r.value, r.source, r.state, r.confidence, r.evidence != "") for r in md.suggest(items, a, b, answers).collect()}
    assert asked[1, "issue"] == ("5", "b", "picked", "low", True) and asked[3, "date"] == ("2001", "model", "model", "low", False)
    assert asked[1, "volume"][:3] == ("3", "a", "both") and (2, "date") not in asked
    why = {(r.item_key, r.field): r.why for r in md.not_suggested(items, md.suggest(items, a)).collect()}
    assert why[2, "date"] == "filled" and why[3, "volume"] == "nothing found" and (1, "volume") not in why
    assert md.suggest(items.limit(0), a, b).count() == 0 and md.suggest(items, a.limit(0)).count() == 0


def test_rules_of_a_line_stand_once_in_the_plan(spark):
    """Filters on what a line holds must not repeat the rules that read it."""
    heads = spark.createDataFrame([("k", "On things\nSan Zhang1, Wei Wang2")], "item_key string, head string")
    plan = md.creators(heads, "item_key")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("申请号") == 1


def test_equal_sources_are_read_once(spark, monkeypatch):
    """Where both sources say the same, the rules read one text, and both are still named as sources."""
    seen, read = [], md._said
    monkeypatch.setattr(md, "_said", lambda head, *more: (seen.extend((r.item_key, r.source) for r in head.collect()), read(head, *more))[1])
    items = spark.createDataFrame([(k, "T", *[None] * 6) for k in (1, 2, 3, 4)], ITEM)
    text = lambda n: f"The Title\n张三1, 李四2\nVol. {n}, No. 2, Dec. 2020" + FILL
    page = "item_key int, page int, text string"
    got = md.suggest(items, spark.createDataFrame([(1, 1, text(3)), (2, 1, text(3)), (3, 1, text(3))], page), spark.createDataFrame([(1, 1, text(3)), (2, 1, text(4)), (4, 1, text(5))], page)).collect()
    assert sorted(seen) == [(1, "ab"), (2, "a"), (2, "b"), (3, "a"), (4, "b")]
    assert {(r.item_key, r.value, r.source, r.state) for r in got if r.field == "volume"} == {(1, "3", "a", "both"), (2, "3", "a", "conflict"), (3, "3", "a", "single"), (4, "5", "b", "single")}
    assert {(r.item_key, r.state) for r in got if r.field == "creators"} == {(1, "both"), (2, "both"), (3, "single"), (4, "single")}


def test_split_at_and_white_space(spark):
    from marginalia.functions import text as tx

    assert one(spark, tx.split_at(F.lit("a1b￿22c"), "[0-9]+")) == ["a", "b￾", "c"] and one(spark, tx.split_at(F.lit("1"), "[0-9]")) == ["", ""]
    assert one(spark, tx.strip(F.lit("　\x85 a b\n \xa0"))) == "a b" and one(spark, tx.strip(F.lit("​\x1c"))) == "​\x1c" and one(spark, tx.strip(F.lit(" \t"))) == ""
