"""Bibliographic metadata of the first pages: dates, volume, issue and pages, author lines, and suggestions for empty fields.

Everything is a Column expression over one text, or a window over the first lines of one item; items never meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import scalars as sc
from marginalia.functions import text as tx
from marginalia.functions.scalars import let, once
from marginalia.operators.extraction import extract_doi
from marginalia.operators.relational import kept
from marginalia.operators.views import evidence

HEAD_PAGES, HEAD_LINES, HEAD_CHARS, LEAST_CHARS, LINE_CHARS = 2, 30, 6000, 200, 160
#: Words that tell a date's kind, within MARKER_REACH characters before it; a date without one is of publication.
MARKERS = {
    "online_first": (
        "网络首发", "网络出版", "网络优先", "在线发表", "在线出版", "在线首发", "优先出版", "优先数字出版", "预出版", "上线",
        "available online", "published online", "first published", "online first", "advance online", "early access", "in press", "epub ahead",
    ),
    "submitted": (
        "收稿", "投稿", "来稿", "修回", "改回", "录用", "接受", "定稿", "审稿",
        "received", "revised", "accepted", "submitted", "article received",
    ),
}
KIND_RANK = {"published": 0, "online_first": 1, "submitted": 2}
MARKER_REACH = 20
#: Spans whose digits are no dates, and words right before a number that is none. Here and below a look-ahead names
#: the characters that a match can begin with: it changes no match, and most places of a text are passed by without a word boundary.
MASKS = r"(?=[1hIC])(?:10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+|https?://\S+|\b(?:ISSN|ISBN)\s*[0-9Xx-]{6,}|\bCN\s*[0-9]{1,2}\s*[-–]\s*[0-9]{3,4}\s*/\s*[A-Za-z])"
NO_YEAR = r"(?i)(?:issn|cn|isbn|no\.?\s*|vol\.?\s*)\s*$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = "(" + "|".join(MONTHS) + r")[a-z]*\.?,?"
#: How dates are written. Groups are numbered by DATE_PARTS: year, month, day (0: none).
DATE_SHAPES = (
    (r"(?U)(?=[12])\b((?:19|20)[0-9]{2})\s*[-/.年]\s*([0-9]{1,2})\s*(?:[-/.月]\s*([0-9]{1,2})\s*日?)?", (1, 2, 3)),
    (rf"(?iU)(?=[jfmasond][aepuco][nbrylgptvc])\b{_MONTH}\s+((?:19|20)[0-9]{{2}})\b", (2, 1, 0)),
    (rf"(?iU)(?=[0-9])\b([0-9]{{1,2}})\s+{_MONTH}\s+((?:19|20)[0-9]{{2}})\b", (3, 2, 1)),
)
_DASH = "[-–—~～]"
#: How volumes, issues and pages are written.
VOLUME_CN, ISSUE_CN = r"(?U)第\s*([0-9]{1,4})\s*卷", r"(?U)(?![!-~])(?<!卷)\s?第\s*([0-9]{1,3})\s*期"
VOLUME_EN, ISSUE_EN = r"(?iU)vol\.?\s*([0-9]{1,4})(?![0-9])", r"(?iU)(?=[ni])\b(?:No|Issue)\.?\s*([0-9]{1,3})(?![0-9])"
CITED = rf"(?U)(?=[0-9])\b([0-9]{{1,4}})\s*\(\s*([0-9]{{1,3}})\s*\)\s*[:：]\s*([0-9]{{1,5}})\s*{_DASH}\s*([0-9]{{1,5}})\b"
CITED_YEAR = rf"(?U)(?=[12])\b(?:19|20)[0-9]{{2}}\s*,\s*([0-9]{{1,4}})\s*\(\s*([0-9]{{1,3}})\s*\)\s*[:：]\s*([0-9]{{1,5}})\s*{_DASH}\s*([0-9]{{1,5}})\b"
PAGES_EN, PAGES_CN = rf"(?iU)(?=p)\b(?:pp?|pages?)\s*\.?\s*([0-9]{{1,5}})\s*{_DASH}\s*([0-9]{{1,5}})\b", rf"(?U)第\s*([0-9]{{1,5}})\s*{_DASH}\s*([0-9]{{1,5}})\s*页"
ARTICLE_NUMBER = r"(?U)文章编号\s*[:：]?\s*[0-9]{4}\s*[-–—]\s*[0-9]{4}\s*\(\s*([0-9]{4})\s*\)\s*([0-9]{1,3})\s*[-–—]\s*([0-9]{4,5})\s*[-–—]\s*([0-9]{2})"
#: What marks a line of authors, and what rules one out.
AUTHOR_LABELS = ("研究生姓名", "学位申请人", "作者姓名", "第一作者", "通讯作者", "作者", "姓名", "authors", "author")
NO_AUTHORS = (
    "摘要", "abstract", "关键词", "keywords", "中图分类号", "文献标识码", "文章编号", "doi", "http", "@", "基金", "收稿", "录用", "修回",
    "引用格式", "简介", "大学", "学院", "研究院", "研究所", "实验室", "编辑部", "出版社", "导师", "指导教师", "学科专业", "专业名称",
    "学位", "答辩", "提交日期", "vol.", "no.", "pp.", "issn", "isbn", "目录", "目次", "版权", "主编", "教授", "研究员", "申请号", "学号",
)
NAME_MARKS = r"\*†‡§¶∗#"
CN_NAME, LATIN_NAME = "^[一-鿿·]{2,8}$", r"^[A-Za-z][A-Za-z'’-]*\.?(?:\s+[A-Za-z][A-Za-z'’-]*\.?){0,2}$"
PARTIAL = r"(?iU)(?=[,，;；、e等])(?:[,，;；、]\s*)?(?:et\s*al\.?|etc\.?|等)\s*$"
MOST_NAMES = 15
FIELDS = ("date", "DOI", "volume", "issue", "pages", "creators")
#: The source that is believed where two differ.
BELIEVED = {"creators": "b"}


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,found>>: the matches of a pattern in order, in characters from 0, the end exclusive.

    A single match whose characters stand in the text once is where they are. Else what lies between the matches gives their places.
    """
    span = lambda start, m: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("found"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("spans"))
    between = lambda t, found: F.zip_with(found, tx.split_at(t, pattern), lambda m, b: F.struct(F.length(b).alias("gap"), m.alias("m")))
    on = lambda state, step: let(state["at"] + step["gap"], lambda start: F.struct((start + F.length(step["m"])).alias("at"), F.concat(state["spans"], F.array(span(start, step["m"]))).alias("spans")))
    all_of = lambda t, found: F.aggregate(F.filter(between(t, found), lambda x: x["m"].isNotNull()), none, on, lambda s: s["spans"])
    only = lambda t, m: let(F.call_function("instr", t, m), lambda at: F.when(F.call_function("locate", m, t, at + 1) == 0, F.array(span(at - 1, m))))
    placed = lambda t, found: F.when(F.size(found) == 0, none["spans"]).otherwise(F.coalesce(F.when(F.size(found) == 1, only(t, F.get(found, F.lit(0)))), all_of(t, found)))
    return let(F.coalesce(text, F.lit("")), lambda t: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: placed(t, found)))


def _before(text: Column, start: Column, reach: int) -> Column:
    low = F.greatest(start - reach, F.lit(0))
    return F.lower(F.call_function("substring", text, low + 1, start - low))


def _nearest(context: Column, words: tuple[str, ...]) -> Column:
    """Where the last of the words begins in a short text; -1 without one."""
    pattern = "(?s)^(.*)(?:" + "|".join(w.replace(".", r"\.") for w in words) + ")"
    return F.when(context.rlike(pattern), F.length(F.regexp_extract(context, pattern, 1))).otherwise(-1)


def date_candidates(text: Column) -> Column:
    """array<struct<rank,shape,start,end,kind,value>>: the dates of a text, the likeliest date of publication first.

    Dates are ISO, slashed, dotted or Chinese ones with a month, ``Mon YYYY`` and ``D Mon YYYY``; a day that can't be is left
    out. Those inside a DOI, URL, ISSN, ISBN or CN number, or right behind the name of such a number, are none. Kind
    goes by the marker that begins nearest before the date. Order: kind, month before day (shape is minus 3 for months, minus 2 for
    days), place; of equal values the first stays. Null and empty texts have none.
    """
    days, numbers = lambda v: v.try_cast("int"), F.array(*map(F.lit, MONTHS))

    def read(t: Column, masks: Column, pattern: str, parts: tuple[int, int, int]) -> Column:
        def value(s: Column) -> Column:
            group = lambda i: F.regexp_extract(s["found"], pattern, i) if i else F.lit("")
            month = days(group(parts[1])) if parts[1] == 2 and parts[0] == 1 else F.array_position(numbers, F.lower(F.substring(group(parts[1]), 1, 3))).cast("int")
            two = lambda n: F.lpad(n.cast("string"), 2, "0")
            shown = lambda m, d: F.when(m.between(1, 12) & d.between(1, 31), F.concat_ws("-", group(parts[0]), two(m), two(d)))
            only = F.lit(None).cast("string") if parts[0] == 3 else None
            return let(month, lambda m: let(days(group(parts[2])), lambda d: F.coalesce(shown(m, d), only if only is not None else F.when(m.between(1, 12), F.concat_ws("-", group(parts[0]), two(m))))))

        def one(s: Column) -> Column:
            free = ~F.exists(masks, lambda m: (s["start"] < m["end"]) & (s["end"] > m["start"]))
            at = lambda c: F.struct(*[_nearest(c, words).alias(k) for k, words in MARKERS.items()])
            kind = lambda n: F.when((n["online_first"] < 0) & (n["submitted"] < 0), "published").when(n["online_first"] >= n["submitted"], "online_first").otherwise("submitted")
            rank = lambda k: F.when(k == "published", 0).when(k == "online_first", 1).otherwise(2)
            row = lambda k, v: F.struct(rank(k).alias("rank"), F.when(F.length(v) > 7, -2).otherwise(-3).alias("shape"), s["start"].alias("start"), s["end"].alias("end"), k.alias("kind"), v.alias("value"))
            return let(_before(t, s["start"], MARKER_REACH), lambda c: let(F.when(free & ~c.rlike(NO_YEAR), value(s)), lambda v: let(at(c), lambda n: let(kind(n), lambda k: row(k, v)))))

        return F.transform(spans(t, pattern), one)

    found = lambda t: let(spans(t, "(?U)" + MASKS), lambda masks: F.array_sort(F.filter(F.concat(*[read(t, masks, *shape) for shape in DATE_SHAPES]), lambda x: x["value"].isNotNull())))
    first = lambda rows: F.filter(rows, lambda x, i: ~F.exists(F.slice(rows, F.lit(1), i), lambda y: y["value"] == x["value"]))
    return let(F.coalesce(text, F.lit("")), lambda t: let(found(t), first))


def best_date(text: Column) -> Column:
    """struct(value, kind, found): the first of the candidates, with its own characters."""
    shown = lambda x: F.when(x.isNotNull(), F.struct(x["value"].alias("value"), x["kind"].alias("kind"), F.call_function("substring", text, x["start"] + 1, x["end"] - x["start"]).alias("found")))
    return let(F.get(date_candidates(text), F.lit(0)), shown)


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def volume_issue_pages(text: Column) -> Column:
    """struct(volume, issue, pages, found): each by the first way of writing that gives it; ``found`` has what matched for each.

    In order: Chinese and English volume and issue, ``37(4): 765-770``, the same behind a year, ``pp. 765-770`` or its Chinese form,
    and an article number, whose last parts are the first page and how many there are; it serves only where pages are still missing.
    """
    ways = {"vc": VOLUME_CN, "ic": ISSUE_CN, "ve": VOLUME_EN, "ie": ISSUE_EN, "c": CITED, "cy": CITED_YEAR, "pe": PAGES_EN, "pc": PAGES_CN, "a": ARTICLE_NUMBER}
    # a text without a sign that every match holds isn't searched
    signs = {"vc": "卷", "ic": "期", "c": "(", "cy": "(", "pc": "页", "a": "文章编号"}

    def read(m: Column) -> Column:
        """From what matched for each way; its groups are the same as in the whole text."""
        part = lambda way, g=1: _part(m[way], ways[way], g)
        both = lambda way, a, b: F.when(m[way].isNotNull(), F.concat_ws("-", part(way, a), part(way, b)))
        first, count = part("a", 3).cast("int"), part("a", 4).cast("int")
        written = F.coalesce(both("c", 3, 4), both("cy", 3, 4), both("pe", 1, 2), both("pc", 1, 2))
        numbered = written.isNull() & m["a"].isNotNull()
        pages = F.coalesce(written, F.when(numbered & (count > 0), F.concat_ws("-", first.cast("string"), (first + count - 1).cast("string"))))
        volume = [("vc", 1), ("ve", 1), ("c", 1), ("cy", 1)]
        issue = [("ic", 1), ("ie", 1), ("c", 2), ("cy", 2)]
        seen = lambda of: F.coalesce(*[m[way] for way in of])
        return F.struct(
            F.coalesce(*[part(*way) for way in volume]).alias("volume"),
            F.coalesce(*[part(*way) for way in issue], F.when(numbered, part("a", 2).cast("int").cast("string"))).alias("issue"),
            pages.alias("pages"),
            F.struct(seen(["vc", "ve", "c", "cy"]).alias("volume"), seen(["ic", "ie", "c", "cy", "a"]).alias("issue"), seen(["c", "cy", "pe", "pc", "a"]).alias("pages")).alias("found"),
        )

    def matches(t: Column) -> Column:
        return F.struct(*[(F.when(t.contains(signs[way]), _part(t, p, 0)) if way in signs else _part(t, p, 0)).alias(way) for way, p in ways.items()])

    return let(F.coalesce(text, F.lit("")), lambda t: let(matches(t), read))


def heads(pages: DataFrame, key: str, page: str = "page", text: str = "text", n: int = HEAD_PAGES) -> DataFrame:
    """(key, head): the first pages joined by a line end, at most HEAD_CHARS characters, as the rules read them."""
    first = pages.where(F.col(page) <= n).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda s: s["t"]), "\n").alias("head"))
    return first.select(key, F.substring(tx.strip(F.col("head")), 1, HEAD_CHARS).alias("head"))


def line_names(line: Column) -> Column:
    """struct(names, partial, marked): the names of a line that lists nothing but names; null for any other line.

    What stands in brackets goes first. Signs and digits around a name are marks, "et al." at the end says that the list is
    partial. One part that looks like no name, or more than MOST_NAMES of them, and the line is none.
    """
    def one(part: Column) -> Column:
        bare = tx.strip(F.regexp_replace(tx.strip(F.regexp_replace(part, f"^[{NAME_MARKS}]+", "")), rf"(?U)[\s\d,，;；{NAME_MARKS}]+$", ""))
        more = lambda b: b.rlike("^[一-鿿·]{2,8}等$")
        return let(bare, lambda b: F.struct(F.when(more(b), F.regexp_replace(b, "等$", "")).otherwise(b).alias("name"), more(b).alias("partial"), (b != part).alias("marked")))

    def read(head: Column) -> Column:
        refused = let(F.lower(head), lambda low: reduce(lambda a, w: a | low.contains(w), NO_AUTHORS, F.lit(False)))
        parts = tx.split_at(tx.strip(F.regexp_replace(head, PARTIAL, "")), r"(?iU)\s*[,，;；、]\s*|\s+(?:and|&)\s+")
        parts = F.filter(F.transform(parts, lambda p: F.regexp_replace(tx.strip(p), r"(?iU)^(?:and|&)\s+", "")), lambda p: p != "")
        like = lambda n: n.rlike(CN_NAME) | (n.rlike(LATIN_NAME) & n.rlike(r"(?:^|\s)[A-Z]"))
        some = lambda named: (F.size(named) > 0) & (F.size(named) <= MOST_NAMES) & F.forall(named, lambda x: like(x["name"]))
        shown = lambda made, named: F.when(some(named), F.struct(F.transform(named, lambda x: x["name"]).alias("names"), (head.rlike(PARTIAL) | F.exists(named, lambda x: x["partial"])).alias("partial"), F.exists(made, lambda x: x["marked"]).alias("marked")))
        listed = let(F.transform(parts, one), lambda made: let(F.filter(made, lambda x: x["name"] != ""), lambda named: shown(made, named)))
        return F.when((head != "") & (F.length(head) <= LINE_CHARS) & ~refused, listed)

    return let(tx.strip(reduce(lambda t, bracket: F.substring_index(t, bracket, 1), "（([【", F.coalesce(line, F.lit("")))), read)


def creators(heads_: DataFrame, key: str, titles: DataFrame | None = None, head: str = "head", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, creators, partial, labeled, score, line): the line of authors among the first HEAD_LINES of a head; ``also`` names
    columns that tell apart several heads of one key.

    titles: (key, title); a line that begins with the title is none. A line counts 3 for a label (or "by" above it), 2 each for
    "et al." and for marks, 1 each for standing in the first 12 lines and below a line of six characters or more. Chinese names
    add 2 when lines are compared, not when it is decided whether the best one has the 2 points it needs. A name alone
    without label or mark is too little. Ties go to the earlier line.
    """
    keys = (key, *also)
    bare = F.transform(F.slice(F.split(F.coalesce(F.col(head), F.lit("")), "\n"), 1, HEAD_LINES), tx.strip)
    lines = once(heads_, "__lines", bare).select(*keys, "__lines", F.posexplode("__lines").alias("pos", "bare"))
    label = _part(F.col("bare"), r"(?iU)^(?:" + "|".join(AUTHOR_LABELS) + r")\s*[:：]\s*(.+)$")
    # what lists no names needs neither what stands above it nor a title
    read = once(lines.where("bare <> ''").withColumn("label", label), "got", line_names(F.coalesce("label", "bare"))).where("got IS NOT NULL")
    above = let(F.filter(F.slice("__lines", F.lit(1), F.col("pos")), lambda x: x != ""), lambda x: F.coalesce(F.get(x, F.size(x) - 1), F.lit("")))
    by = F.lower(F.regexp_replace("above", r"(?U)^[\s:：]+|[\s:：]+$", "")) == "by"
    read = read.withColumn("above", above).withColumn("labeled", F.col("label").isNotNull() | by).drop("__lines")
    if titles is not None:
        squeeze = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), tx.SPACE, "")
        read = read.join(titles.select(key, squeeze(F.col("title")).alias("__title")), key, "left")
        read = read.where((F.coalesce("__title", F.lit("")) == "") | ~squeeze(F.col("bare")).startswith(F.col("__title")))
    read = read.where("labeled OR size(got.names) > 1 OR got.partial OR got.marked")
    score = F.when(F.col("labeled"), 3).otherwise(0) + F.when(F.col("got.partial"), 2).otherwise(0) + F.when(F.col("got.marked"), 2).otherwise(0) + F.when(F.col("pos") < 12, 1).otherwise(0) + F.when(F.length("above") >= 6, 1).otherwise(0)
    ranked = read.withColumn("score", score).withColumn("rank", F.col("score") + F.when(F.exists("got.names", lambda n: n.rlike("[一-鿿]")), 2).otherwise(0))
    best = ranked.where("rank > 0").groupBy(*keys).agg(F.min_by(F.struct("got", "labeled", "score", "bare"), F.struct(-F.col("rank"), "pos")).alias("b")).where("b.score >= 2")
    made = F.filter(F.transform("b.got.names", lambda n: let(n, sc.split_name)), lambda n: (n["last"] != "") | (n["first"] != ""))
    return once(best, "creators", made).select(*keys, "creators", "b.got.partial", "b.labeled", "b.score", F.col("b.bare").alias("line")).where(F.size("creators") > 0)


def creators_line(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat_ws(", ", F.nullif(n["last"], F.lit("")), F.nullif(n["first"], F.lit("")))), "; ")


def field_candidates(pages: DataFrame, key: str, titles: DataFrame | None = None) -> DataFrame:
    """(key, field, value, kind, found): what the first pages of one source say; pages that hold under LEAST_CHARS say nothing."""
    return _said(heads(pages, key), key, titles)


def _said(head: DataFrame, key: str, titles: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """field_candidates of heads."""
    head = head.where(F.length("head") >= LEAST_CHARS)
    t = F.col("head")
    read = once(head, "r", F.struct(best_date(t).alias("d"), F.nullif(extract_doi(t), F.lit("")).alias("doi"), volume_issue_pages(t).alias("v")))
    row = lambda name, value, kind, found: F.struct(F.lit(name).alias("field"), value.alias("value"), kind.alias("kind"), found.alias("found"))
    none = F.lit(None).cast("string")
    rows = F.array(
        row("date", F.col("r.d.value"), F.col("r.d.kind"), F.col("r.d.found")), row("DOI", F.col("r.doi"), none, F.col("r.doi")),
        *[row(n, F.col(f"r.v.{n}"), none, F.col(f"r.v.found.{n}")) for n in ("volume", "issue", "pages")],
    )
    plain = read.select(key, *also, F.inline(rows)).where("value IS NOT NULL")
    people = creators(head, key, titles, also=also).select(key, *also, F.lit("creators").alias("field"), creators_line(F.col("creators")).alias("value"), F.when(F.col("partial"), "partial").alias("kind"), F.substring("line", 1, LINE_CHARS).alias("found"))
    return plain.unionByName(people)


def _same(field: Column, value: Column) -> Column:
    """A value as it is compared: never a change of meaning."""
    v = tx.strip(value)
    tight = F.regexp_replace(v, tx.SPACE, "")
    return F.when(field.isin("pages", "volume", "issue"), F.regexp_replace(tight, "[~—–]", "-")).when(field == "DOI", F.lower(F.replace(v, F.lit(" "), F.lit("")))).when(field == "creators", tight).otherwise(F.regexp_replace(v, tx.SPACE, " "))


def suggest(items: DataFrame, a: DataFrame, b: DataFrame | None = None, answers: DataFrame | None = None, key: str = "item_key") -> DataFrame:
    """(key, field, value, source, state, confidence, kind, other, evidence): suggestions for the fields that are empty.

    items: key, title and a column for each of FIELDS; a field with a value gets none, and authors are all or nothing. a, b: (key, page,
    text) of two sources of the text. state: both, single or conflict; where the sources differ, BELIEVED says which one
    counts, and the other value is given too. answers: (key, field, value) of a model, which decide conflicts (state picked) and
    fill what the rules leave empty; without a match in the text they have no evidence and are of low confidence.
    """
    titles = items.select(key, "title")
    empty = items.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "").alias("empty")) for f in FIELDS])).alias("f")).where("f.empty").select(key, "f.field")
    # both sources are read in one pass, and once where they say the same; what is stored keeps the long rules out of every later plan
    text = heads(a, key).withColumnRenamed("head", "__a")
    text = kept(text.withColumn("__b", F.lit(None).cast("string")) if b is None else text.join(heads(b, key).withColumnRenamed("head", "__b"), key, "full_outer"))
    same = F.col("__a") == F.col("__b")
    both = F.array(F.struct(F.when(same, "ab").otherwise("a").alias("source"), F.col("__a").alias("head")), F.struct(F.lit("b").alias("source"), F.when(same, F.lit(None)).otherwise(F.col("__b")).alias("head")))
    read = text.select(key, F.inline(both)).where("head IS NOT NULL")
    said = kept(_said(read, key, titles, ("source",))).withColumn("source", F.explode(F.split("source", "")))
    one = F.struct("source", "value", "kind", "found", _same(F.col("field"), F.col("value")).alias("same"))
    merged = said.groupBy(key, "field").agg(F.array_sort(F.collect_list(one)).alias("vs"))
    rows = empty.join(merged, [key, "field"], "left")
    preferred = F.create_map(*[F.lit(x) for kv in BELIEVED.items() for x in kv])
    differ = F.size(F.array_distinct(F.transform("vs", lambda v: v["same"]))) > 1
    trusted = F.get(F.filter("vs", lambda v: v["source"] == F.coalesce(preferred[F.col("field")], F.lit("a"))), F.lit(0))
    rows = rows.withColumns({"differ": F.coalesce(differ, F.lit(False)), "pick": F.when(differ, F.coalesce(trusted, F.get("vs", F.lit(0)))).otherwise(F.get("vs", F.lit(0)))})
    state = F.when(F.col("differ"), "conflict").when(F.size("vs") > 1, "both").when(F.size("vs") == 1, "single")
    if answers is not None:
        rows = rows.join(answers.select(key, "field", F.nullif(tx.strip(F.col("value")), F.lit("")).alias("answer")), [key, "field"], "left")
        asked = F.col("answer").isNotNull() & (F.col("differ") | F.col("vs").isNull())
        match = F.get(F.filter("vs", lambda v: v["same"] == _same(F.col("field"), F.col("answer"))), F.lit(0))
        free = F.struct(F.lit("model").alias("source"), F.col("answer").alias("value"), F.lit(None).cast("string").alias("kind"), F.col("answer").alias("found"), F.lit("").alias("same"))
        state = F.when(asked & match.isNotNull(), "picked").when(asked, "model").otherwise(state)
        rows = rows.withColumns({"state": state, "pick": F.when(asked, F.coalesce(match, free)).otherwise(F.col("pick"))})
    else:
        rows = rows.withColumn("state", state)
    confidence = F.when(F.col("state").isin("both", "single"), "high").when(F.col("state") == "conflict", "medium").otherwise("low")
    other = F.get(F.filter("vs", lambda v: v["source"] != F.col("pick.source")), F.lit(0))["value"]
    where = F.when(F.col("pick.source") == "b", F.col("__b")).otherwise(F.coalesce("__a", "__b"))
    return rows.where("pick IS NOT NULL").join(text, key, "left").select(
        key, "field", "pick.value", "pick.source", "state", confidence.alias("confidence"), "pick.kind", F.when(F.col("state").isin("conflict", "picked", "model"), other).alias("other"),
        evidence(F.coalesce(where, F.lit("")), F.col("pick.found")).alias("evidence"),
    )


def not_suggested(items: DataFrame, suggestions: DataFrame, key: str = "item_key") -> DataFrame:
    """(key, field, why): fields without a suggestion: ``filled`` or ``nothing found``."""
    state = items.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "", "nothing found").otherwise("filled").alias("why")) for f in FIELDS])).alias("f")).select(key, "f.*")
    return state.join(suggestions.select(key, "field"), [key, "field"], "left_anti")
