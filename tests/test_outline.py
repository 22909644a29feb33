"""Outlines against a plain version that follows the rules block by block; chunk collection; inventories."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.operators import chunking as ck
from marginalia.operators import extraction as ex
from marginalia.operators import outline as ol
from marginalia.operators import views as vw


def plain_outline(blocks):
    out, title, level, pages, parts, any_title = [], "", 0, [], [], False

    def close():
        if parts:
            out.append([title, level, pages[0], pages[-1], "\n\n".join(parts)])

    for page, kind, content, lvl, shown in blocks:
        if kind in ol.TITLES:
            close()
            title, level, pages, parts = (content or "").strip(), lvl or 1, [page], []
        elif (shown or "").strip():
            pages, parts = [*pages, page], [*parts, shown]
    close()
    if not any(s[0] for s in out):
        out, text, pages, size = [], [], [], 0
        for page, _, _, _, shown in blocks + [(None, None, None, None, None)]:
            if text and (page is None or size >= 4000):
                out.append([f"第 {len(out) + 1} 段", 9, pages[0], pages[-1], "\n\n".join(text).strip()])
                text, pages, size = [], [], 0
            if (shown or "").strip():
                text, pages, size = [*text, shown], [*pages, page], size + len(shown)
        return [(*s, fp(s)) for s in out]
    if len(out) > 1 and not out[0][0] and len(out[0][4]) < 120:
        out[1][2], out[1][4] = min(out[0][2], out[1][2]), out[0][4] + "\n\n" + out[1][4]
        out.pop(0)
    i = 1
    while i < len(out):
        if len(out[i][4]) < 120 and len(out[i - 1][4]) + len(out[i][4]) < 9000:
            out[i - 1][4] += "\n\n" + out[i][4]
            out[i - 1][3] = max(out[i - 1][3], out[i][3])
            out.pop(i)
        else:
            i += 1
    cut = []
    for s in out:
        if len(s[4]) <= 9000:
            cut.append(s)
            continue
        parts = []
        for p in [p for p in re.split(r"\n\s*\n", s[4]) if p.strip()]:
            if parts and sum(map(len, parts[-1])) + len(p) <= 9000:
                parts[-1].append(p)
            else:
                parts.append([p])
        cut += [[s[0] + (f"（续 {k}）" if k > 1 else ""), *s[1:4], "\n\n".join(p)] for k, p in enumerate(parts, 1)]
    while len(cut) > 24:
        new, k = [], 0
        while k < len(cut):
            a, b = cut[k], cut[k + 1] if k + 1 < len(cut) else None
            if b and len(a[4]) + len(b[4]) < 9000:
                new.append([a[0] or b[0], min(a[1] or 9, b[1] or 9), min(a[2], b[2]), max(a[3], b[3]), a[4] + "\n\n" + b[4]])
                k += 2
            else:
                new.append(a)
                k += 1
        if len(new) == len(cut):
            break
        cut = new
    for n, s in enumerate(cut, 1):
        s[0] = s[0] or f"第 {n} 段"
    return [(*s, fp(s)) for s in cut]


def fp(s):
    return hashlib.sha1(f"{s[0]}|{s[4][:2000]}".encode()).hexdigest()[:6]


def rows(found):
    return [(s["title"], s["level"], s["page_from"], s["page_to"], s["text"], s["fp"]) for s in found]


SIZES = st.sampled_from([0, 1, 5, 119, 120, 400, 2500, 4100, 8900, 9001])
BLOCK = st.tuples(st.sampled_from(["text", "text", "text", "title", "paragraph_title"]), SIZES, st.sampled_from(["", "T", "Intro", "References"]), st.sampled_from([None, 1, 2, 5]), st.sampled_from(["x", "y\n\nz ", "  "]))


@settings(max_examples=300, deadline=None)
@given(st.lists(BLOCK, max_size=60))
def test_outline_as_the_rules_say(blocks):
    made = []
    for i, (kind, size, title, level, unit) in enumerate(blocks):
        content = title if kind != "text" else (unit * size)[:size]
        made.append((i // 4 + 1, kind, content, level, f"# {content}" if kind != "text" else content))
    assert rows(ol.outline(made)) == plain_outline(made)


def test_document_outlines(spark):
    blocks = spark.createDataFrame([
        ("a", 1, 0, "header", "running", None, None, None), ("a", 1, 1, "doc_title", "Paper", 1, None, None), ("a", 1, 2, "text", "w" * 130, None, None, None), ("a", 2, 0, "paragraph_title", "References", 2, None, None),
        ("a", 2, 1, "equation", "x=1", None, None, None), ("a", 2, 2, "image", "", None, "Fig", "p.jpg"), ("b", 1, 0, "text", "no titles", None, None, None), ("b", 3, 0, "title", None, None, None, None),
        ("c", 1, 0, "footer", "nothing else", None, None, None), ("d", 1, 0, "text", None, None, None, None),
    ], "doc string, page int, pos int, type string, content string, level int, caption string, image string")
    got = {(r.doc, r.seq): (r.title, r.level, r.page_from, r.page_to, r.text, r.skip) for r in ol.document_outlines(blocks, "doc").collect()}
    assert got == {
        ("a", 0): ("Paper", 1, 1, 2, "w" * 130 + "\n\n$$x=1$$\n\n![Fig](p.jpg)\nFig", False), ("b", 0): ("第 1 段", 9, 1, 3, "no titles\n\n#", False),
    }
    assert ol.document_outlines(blocks.limit(0), "doc").count() == 0
    text = {r.page: r.text for r in ex.render_blocks(blocks.where("doc = 'a'"), "doc").collect()}
    assert text == {1: "# Paper\n\n" + "w" * 130, 2: "### References\n\n$$x=1$$\n\n![Fig](p.jpg)\nFig"}


ITEMS = "item_key string, title string, author_line string, year string, summary string, abstract string"


def test_whole_chunk_collection(spark):
    items = spark.createDataFrame([("k", "T", "A", "2020", "", "An abstract."), ("e", "Empty", "", "", "", "")], ITEMS)
    long = "A sentence stands here. " * 40
    pages = spark.createDataFrame([("k", 1, f"# 1 One\nfirst words\n## 1.1 Part\n{long}\n### 1.1.1 Deep\n{long}"), ("k", 2, "# References\n[1] somebody wrote this"), ("e", 1, "")], "item_key string, page int, text string")
    one, other = "one note that is long enough to be a chunk, or so " * 4 + "end", "a note of the item that has no text, and long too " * 4 + "end"
    notes = spark.createDataFrame([("k", one), ("k", " "), ("e", other), ("nobody", one)], "item_key string, text string")
    marks = spark.createDataFrame([("k", "7", "marked words", "why"), ("k", "iv", "more marked words", None), ("k", "8", "short", "")], "item_key string, page string, text string, comment string")
    secs = ck.sectionize(pages, "item_key")
    got = ck.collect_chunks(items, secs, annotations=marks, notes=notes).orderBy("item_key", "seq").collect()
    k = [r for r in got if r.item_key == "k"]
    assert [r.seq for r in k] == list(range(len(k))) and [r.level for r in k] == sorted(r.level for r in k)
    parents = {r.seq: r for r in k if r.level == 0}
    assert [p.title for p in parents.values()] == ["1 One", "1.1 Part"] and all(p.depth == 1 and not p.indexable for p in parents.values())
    assert parents[0].text.startswith("first words\n\nA sentence") and len(parents[0].text) > 2 * len(long) - 10 and parents[1].text.count("A sentence") == 80
    kids = [r for r in k if r.kind == "fulltext" and r.level == 1]
    assert {(r.path, r.parent_seq) for r in kids} == {("1 One", 0), ("1 One > 1.1 Part", 1), ("1 One > 1.1 Part > 1.1.1 Deep", 1), ("1 One > 1.1 Part > References", 1)} and all(r.text.startswith(r.path + "\n") for r in kids)
    assert {r.indexable for r in kids if r.section == "refs"} == {False} and {r.indexable for r in kids if r.section == "body"} == {True}
    assert [(r.page_from, r.text) for r in k if r.kind == "annotation"] == [(0, "[T · 第 iv 页 高亮]\nmore marked words"), (7, "[T · 第 7 页 高亮]（批注：why）\nmarked words")]
    assert [r.text for r in k if r.kind == "note"] == ["[T · 笔记]\n" + one] and k[-1].kind == "doc" and k[-1].depth == 2
    assert [(r.seq, r.text) for r in got if r.item_key == "e"] == [(0, "[Empty · 笔记]\n" + other)] and {r.item_key for r in got} == {"k", "e"}
    assert all(r.indexable for r in ck.collect_chunks(items, secs, nonbody=True).where("level = 1").collect())


def test_children_belong_to_the_part_that_holds_them(spark):
    text = "\n\n".join(f"Paragraph {i} has words. " * 20 for i in range(30))
    pages = spark.createDataFrame([("k", 1, f"# 1 Long\n{text}")], "item_key string, page int, text string")
    items = spark.createDataFrame([("k", "T", "", "", "", "")], ITEMS)
    rows_ = ck.collect_chunks(items, ck.sectionize(pages, "item_key")).collect()
    parents = sorted((r for r in rows_ if r.level == 0), key=lambda r: r.seq)
    assert len(parents) > 2 and parents[1].title == "1 Long（续 2）"
    starts = [p.offset for p in parents]
    for r in rows_:
        if r.level == 1:
            assert r.parent_seq == max(i for i, s in enumerate(starts) if s <= r.offset)


def test_key_inventory(spark):
    x = spark.createDataFrame([("A: 1\nB: x;y\nA: 3",), ("A: 2020-01-02\nnot a line",), ("A: 12\nC:",), (None,), ("",)], "extra string")
    got = {r.key: (r.n, r.filled, r["shape"], [tuple(s) for s in r.shapes], r.repeated, r.longest) for r in vw.key_inventory(x).collect()}
    assert got == {"A": (3, 3, "number", [("9", 2), ("9-9-9", 1)], 1, 10), "B": (1, 1, "list", [("a;a", 1)], 0, 3), "C": (1, 0, "text", [("", 1)], 0, 0)}
    assert vw.key_inventory(x.limit(0)).count() == 0
    assert spark.range(1).select(vw.value_shape(F.lit("中文 12ab-XY z")).alias("v")).first().v == "字 9a-A a"


def plain_sections(pages):
    """Line by line, with the sections that are open."""
    secs, open_, last, out = [], [], 1, []

    def begin(title, level, kind):
        open_[:] = [i for i in open_ if secs[i][1] < level]
        above = open_[-1] if open_ else None
        if kind == "body" and above is not None and secs[above][2] in ("refs", "ack", "toc", "appendix"):
            kind = secs[above][2]
        secs.append([title, level, kind, [], above])
        open_.append(len(secs) - 1)

    for page, text in pages:
        for line in (text or "").splitlines():
            m = ck.HEADING.match(line)
            if m:
                level = ck.heading_depth(m[2]) or last
                flat = [secs[i][1] for i in open_ if secs[i][2] in ck.FLAT_KINDS]
                if not flat or (level <= flat[-1] and not ck.TOC_LINE.search(line)):
                    begin(m[2], level, ck.kind_of(m[2], "body"))
                    last = level
                    continue
            if not secs:
                begin("", 1, "body")
            secs[-1][3].append((page, line))
    for i, (title, level, kind, lines, above) in enumerate(secs):
        text = "\n".join(x for _, x in lines)
        if text.strip() or any(s[4] == i for s in secs):
            names, at = [title], above
            while at is not None:
                names, at = [secs[at][0], *names], secs[at][4]
            out.append({"title": title, "path": " > ".join(n for n in names if n), "level": level, "kind": kind, "page_from": lines[0][0] if lines else 0, "page_to": lines[-1][0] if lines else 0, "text": text})
    return out


LINE = st.sampled_from(["words", "", "  ", "# 1 One", "## 1.1 Part", "### 1.1.1 Deep", "# 2 Two", "# Notes", "# References", "## 参考文献", "# Appendix", "## A.1 More", "# Contents", "# 目录", "## 1.2 Part ..... 7", "# 第三章 Ende", "# Literature review", "致谢", "# 致谢"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5), st.lists(LINE, max_size=12).map("\n".join)), max_size=4))
def test_sections_as_the_rules_say(pages):
    assert ck.sections(pages) == plain_sections(pages)


def test_formulas(spark):
    texts = ["x $$a = b \\tag{1}$$ y $$c$$", "none", "$$ multi\nline $$ and $$a=b$$", "", "$$open", "$$$$ $$q$$"]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "k int, page int, text string")
    new, old = "z", " a =b"
    got = df.select("k", *[ol.formula_replaced(F.col("text"), F.lit(new), nth=F.lit(n)).alias(f"n{n}") for n in (0, 1)], ol.formula_replaced(F.col("text"), F.lit(new), old=F.lit(old)).alias("o"), ol.formula_replaced(F.col("text"), F.lit("t \\tag{9}"), nth=F.lit(0)).alias("t")).collect()
    for r in got:
        text = texts[r.k]
        assert (r.n0, r.n1, r.o, r.t) == (ol.replace_formula(text, new, nth=0), ol.replace_formula(text, new, nth=1), ol.replace_formula(text, new, old=old), ol.replace_formula(text, "t \\tag{9}", nth=0)), text
    listed = {(r.k, r.nth): (r.formula, r.tag, r.start) for r in ol.formulas(df, "k").collect()}
    assert listed[0, 0] == ("a = b \\tag{1}", "1", 2) and listed[0, 1] == ("c", None, 22) and listed[2, 0] == ("multi\nline", None, 0) and (4, 0) not in listed
