"""Rules on literal rows: one case for each."""

import math
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.functions import scalars as sc
from marginalia.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text,expected", [
    ("叶 建 成 等 : 航 天 器", "叶建成等 : 航天器"), ("deep  learning 模 型", "deep  learning 模型"), ("", "")])
def test_cjk_spacing(spark, text, expected):
    assert one(spark, tx.strip_cjk_spacing(F.lit(text))) == expected


@pytest.mark.parametrize("text,expected", [("a research-\ner  went\r\n12\n.\nok", "a researcher went\nok"), (None, ""), ("x\n\n\n\ny", "x\ny")])
def test_clean_text(spark, text, expected):
    assert one(spark, tx.clean_text(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize("text,level", [("第2章", 1), ("1", 1), ("1.2 x", 2), ("1.2.3.4", 3), ("Intro", 0), ("3D printing", 0)])
def test_heading_level(spark, text, level):
    assert one(spark, tx.heading_level(F.lit(text))) == level


@pytest.mark.parametrize("text,kind", [("参 考 文 献", "refs"), ("References", "refs"), ("致谢", "ack"), ("Related Work", "review"), ("Method", "body")])
def test_section_kind(spark, text, kind):
    assert one(spark, tx.section_kind(F.lit(text))) == kind


@pytest.mark.parametrize("text,expected", [
    ("汉<sup>[1]</sup>", "汉"), ("m<sup>2</sup>", "m<sup>2</sup>"), ("[3](u)", "[3](u)"), ("word [1-3] and [4]", "word  and "), ("$$[1]$$ x [2]", "$$[1]$$ x "), ("5<sup>[35]</sup>", "5<sup>[35]</sup>"),
    ("a\nISSN 1234\nb", "a\nb"), ("Telescope\nx", "Telescope\nx")])
def test_clean_for_index(spark, text, expected):
    got = one(spark, tx.clean_for_index(F.lit(text)))
    assert got == expected
    assert one(spark, tx.clean_for_index(F.lit(got))) == got


def test_sentences(spark):
    assert one(spark, tx.split_sentences(F.lit("一句。二句！Three. Four?"))) == ["一句。", "二句！", "Three.", "Four?"]
    assert one(spark, tx.join_sentences(F.lit("一。"), F.lit("二"))) == "一。二"
    assert one(spark, tx.join_sentences(F.lit("a."), F.lit("b"))) == "a. b"


def test_deshift(spark):
    assert one(spark, tx.deshift(F.lit("&DOFXODWLRQ DQG"), 29)) == "Calculation and"
    plain = "the cat and the dog of it were in this for that with as on by be an we " * 20
    moved = one(spark, tx.deshift(F.lit(plain), -7))
    assert one(spark, tx.best_shift(F.lit(moved)))["shift"] == 7 - 32  # upper case reads as well, and is tried first


ODD = [
    None, "", " ", "a", "the", "of the", "The THE tHe the_ the1 _the 1the", "the\u0301 the\u203fx \u0130s \u0131s \u017fuch", "\x1cthe\x1f\x0b\x85\u3000of\xa0",
    "汉字the汉 the汉字，of。", "الف ०१ ก the 😀of😀 x😀y", "é the éthe theé ½the the½ Ⅷof", "ab" * 40 + " whichever which", "~}|{ the !\"# of", "\x7fthe\x00of\n",
    "".join(map(chr, range(33, 127))) * 3, *(tx._shift_map(n)[1][:60] + " " + "the which And OF it".translate(str.maketrans(*tx._shift_map(n))) for n in (-40, -29, -1, 3, 31, 40)),
]


def counted(text):
    """(words, common) by the SQL's rules."""
    import re

    low = "".join("i" if c == "\u0130" else c.lower() for c in text)
    tokens = "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in low).split(" ")
    return len(re.findall("[A-Za-z]{2,}", text)), sum(w in tx.COMMON_WORDS for w in tokens)


@pytest.mark.parametrize("size", [4, 1 << 18])
def test_counts_of_odd_texts(monkeypatch, size):
    monkeypatch.setattr(tx, "SLICE_CHARS", size)
    got = tx.count_texts(pa.array(ODD), tx._known()).tolist()
    for text, row in zip(ODD, got):
        t = "".join((text or "").split())
        own = [len(t), sum("一" <= c <= "鿿" for c in t), sum(c.isascii() and c.isalpha() for c in t), sum("\u0900" <= c <= "\u09ff" or "\u0f00" <= c <= "\u0fff" or "\u0590" <= c <= "\u06ff" or "\u0e00" <= c <= "\u0e7f" for c in t)]
        assert row == [*own, *counted(text or "")], text


def test_counts_of_broken_bytes():
    rows = pa.array([b"the \xff of", b"\xe6\xb1"]).view(pa.string())
    assert tx.count_texts(rows, tx._known()).tolist() == [[6, 0, 5, 0, 2, 2], [1, 0, 0, 0, 0, 0]]


def test_all_shifts_at_once():
    """Every shift's share is that of the shifted text, whatever stands beside it."""
    texts = [t or "" for t in ODD] + ["Of the and " * 200, ""]
    for text, got in zip(texts, tx.shift_ratios(texts, tx._known()), strict=True):
        for shift, ratio in zip(tx.SHIFTS, got, strict=True):
            words, common = counted(text.translate(str.maketrans(*tx._shift_map(shift))))
            assert ratio == (common / words if words else 0), (text, shift)


def test_shift_scan_counts_a_text_once(spark):
    """Texts are dealt out first, then counted in one pass that builds no matches."""
    from marginalia.plans import queries as q

    plan = q.shift_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and plan.count("ArrowEvalPython") == 2
    assert plan.index("Filter") < plan.index("Exchange")


def test_item_health_counts_a_text_once(spark):
    """One count and one scan of suspects; the scan takes in suspects only."""
    from marginalia.operators import extraction as ex

    plain = "the cat and the dog of it were in this for that with as on by be an we " * 20
    rows = [(1, plain.translate(str.maketrans(*tx._shift_map(3)))), (2, plain), (3, "zzzzzz qqqqqq " * 150), (4, None), (5, "short"), (6, "汉字" * 200)]
    found = ex.item_health(spark.createDataFrame(rows, "d int, text string").repartition(1))
    assert {r.d: r.verdict for r in found.collect()} == {1: "bad", 2: "ok", 3: "unsure", 4: "bad", 5: "bad", 6: "ok"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and plan.count("run(") == 2


def test_html(spark):
    got = one(spark, tx.html_to_markdown(F.lit('<h2> T </h2><p>a <b>b</b> &amp; <a href="u">l</a></p><ul><li>x</li></ul><img src="z">')))
    assert got == "## T\n\na **b** & [l](u)\n\n- x"


def test_verdict(spark):
    def verdict(text):
        df = tx.with_char_stats(spark.createDataFrame([(text,)], "text string"))
        return df.select(tx.text_verdict({c: F.col(c) for c in df.columns})).first()[0]

    assert verdict("abc") == "bad"
    assert verdict("english words " * 20) == "ok"
    assert verdict("汉字" * 100) == "ok"
    assert verdict("1234567890" * 20) == "bad"
    assert verdict("ก" * 50 + "汉" * 150) == "bad"


@pytest.mark.parametrize("year,base", [("2024", 1.05), ("2030", 1.05), ("2009", 0.95), ("", 1.0), ("1700", 1.0), (None, 1.0), ("2014-05", round(1.05 - 0.1 * 10 / 15, 6))])
def test_recency(spark, year, base):
    assert one(spark, sc.recency_base(F.lit(year).cast("string"), 2024)) == pytest.approx(base)


@pytest.mark.parametrize("pinned,effective,expected", [(0, 0, 1.0), (0, 1, 1 + math.log(3)), (1, 0, 1 + math.log(4)), (0, 3, 1 + math.log(7))])
def test_multiplier(spark, pinned, effective, expected):
    raw = sc.raw_weight(F.lit(1.0), F.lit(pinned), F.lit(0.0), F.lit(effective), F.lit(0), F.lit(0))
    assert one(spark, sc.weight_multiplier(raw)) == pytest.approx(expected)
    assert one(spark, sc.weight_multiplier(raw, F.lit(True))) == pytest.approx(expected / 4)


def test_multiplier_of_nothing(spark):
    assert one(spark, sc.weight_multiplier(F.lit(-1.0))) == 0.0


@pytest.mark.parametrize("year,low,high,keep", [("", 1990, None, False), ("", None, 2000, True), ("1999", 1990, 2000, True), ("12abc", 1, None, False)])
def test_year_filter(spark, year, low, high, keep):
    assert one(spark, sc.year_filter(F.lit(year), low, high)) is keep


def test_scalars(spark):
    assert one(spark, sc.number_prefix(F.lit("12abc"))) == 12
    assert one(spark, sc.normalize_doi(F.lit("https://doi.org/10.1000/ABC."))) == "10.1000/abc"
    assert one(spark, sc.normalize_doi(F.lit("nonsense"))) == ""
    assert tuple(one(spark, sc.article_pages(F.lit("x(2024)03-0296-05")))) == (2024, 3, "296-300")
    assert one(spark, sc.partial_date(F.lit("发表于2023年5月"))) == "2023-05"
    assert one(spark, sc.partial_date(F.lit("2023/05/07"))) == "2023-05-07"
    assert tuple(one(spark, sc.split_name(F.lit("Doe, Jane")))) == ("Doe", "Jane")
    assert tuple(one(spark, sc.split_name(F.lit("Jane Mary Doe")))) == ("Doe", "Jane Mary")
    assert tuple(one(spark, sc.split_name(F.lit("王小明")))) == ("王小明", "")
    for name, parts in {"ZHANG San": ("ZHANG", "San"), "Sammy Davis Jr.": ("Sammy Davis Jr.", ""), "Johannes van der Waals": ("Johannes van der Waals", ""), "Li-Na Wu": ("Li-Na Wu", ""), "A B C D": ("A B C D", ""), "Jane Doe": ("Doe", "Jane"), "Plato": ("Plato", ""), "LI WEI": ("LI WEI", ""), "Doe,": ("Doe,", ""), "": ("", "")}.items():
        assert tuple(one(spark, sc.split_name(F.lit(name)))) == parts, name
    assert one(spark, sc.human_size(F.lit(1536))) == "1.5 KB"
    assert one(spark, sc.short_author(F.lit("Alice Brown"))) == "Brown A."


def test_units(spark):
    got = {tuple(x) for x in one(spark, tx.coverage_units(F.lit("学习机 AB ab")))}
    assert got == {("学习机", 9.0), ("学习", 4.0), ("习机", 4.0), ("学", 1.0), ("习", 1.0), ("机", 1.0), ("ab", 4.0)}
    from marginalia.plans.search import parse_units

    assert {tuple(x) for x in parse_units("学习机 AB ab")} == got
    assert parse_units("123 456") == []


def test_extras(spark):
    text = "DOI: 1\nDOI: 2\nfree line\nclc：TP1"
    assert one(spark, tx.parse_extra(F.lit(text))) == {"DOI": "1", "clc": "TP1"}
    assert one(spark, tx.unparsed_extra(F.lit(text))) == "free line"


def test_snippet(spark):
    text = "x" * 300 + " needle " + "y" * 300
    got = one(spark, tx.snippet(F.lit(text), F.array(F.lit("needle"))))
    assert got.startswith("…") and got.endswith("…") and "needle" in got
    assert one(spark, tx.snippet(F.lit("short"), F.array(F.lit("none")))) == "short…"
