"""Outlines of documents: sections from title blocks, windows without titles, merging and cutting to size."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.scalars import let
from marginalia.functions.text import strip
from marginalia.operators.extraction import DROPPED_BLOCKS, block_text
from marginalia.operators.metadata import spans

#: Sizes in characters, the most sections of a document, and how much of a section its fingerprint covers.
WINDOW_CHARS, SHORT, LONG, MAX_SECTIONS, PRINT_CHARS = 4000, 120, 9000, 24, 2000
OUTLINE = "array<struct<title:string,level:int,page_from:int,page_to:int,text:string,skip:boolean,fp:string>>"
TITLES = ("title", "paragraph_title", "doc_title", "section_title", "heading")
NO_LEVEL = 9
#: Titles of sections that need no summary.
SKIPPED = re.compile(
    r"参\s*考\s*文\s*献|文\s*献\s*参\s*考|引\s*用\s*文\s*献|references?|bibliograph(?:y|ies)|works\s+cited|literature\s+cited|致\s*谢|acknowledg|附录|appendix|作者简介|攻读学位期间|发表论文|index",
    re.IGNORECASE,
)


class Section(NamedTuple):
    title: str
    level: int
    page_from: int
    page_to: int
    text: str


def fingerprint(title: str, text: str) -> str:
    """Six hex digits that change when the title or the first 2000 characters do."""
    return hashlib.sha1(f"{title}|{text[:PRINT_CHARS]}".encode()).hexdigest()[:6]


def _joined(a: Section, b: Section, **kept) -> Section:
    return Section(a.title or b.title, min(a.level or NO_LEVEL, b.level or NO_LEVEL), min(a.page_from, b.page_from), max(a.page_to, b.page_to), f"{a.text}\n\n{b.text}")._replace(**kept)


def _fit(a: Section, b: Section) -> bool:
    return len(a.text) + len(b.text) < LONG


def _cut(section: Section) -> list[Section]:
    """A section as it is, or its paragraphs in parts of about LONG characters; one paragraph is never cut."""
    if len(section.text) <= LONG:
        return [section]
    parts: list[list[str]] = []
    room = -1
    for p in (p for p in re.split(r"\n\s*\n", section.text) if p.strip()):
        if room < len(p):
            parts.append([])
            room = LONG
        parts[-1].append(p)
        room -= len(p)
    return [section._replace(title=section.title if i == 1 else f"{section.title}（续 {i}）", text="\n\n".join(p)) for i, p in enumerate(parts, 1)]


def _windows(pages: np.ndarray, texts: list[str]) -> list[Section]:
    """Blocks in windows, each of which ends with the block that brings it to WINDOW_CHARS; the sums of the blocks' lengths
    tell where, and with that on which pages."""
    upto, start, out = np.cumsum([len(t) for t in texts]), 0, []
    while start < len(texts):
        end = min(int(np.searchsorted(upto, (upto[start - 1] if start else 0) + WINDOW_CHARS)) + 1, len(texts))
        if text := "\n\n".join(texts[start:end]).strip():
            out.append(Section(f"第 {len(out) + 1} 段", NO_LEVEL, int(pages[start]), int(pages[end - 1]), text))
        start = end
    return out


def outline(blocks: list[tuple[int, str, str, int | None, str]]) -> list[dict]:
    """Sections from (page, type, content, level, rendered) blocks in order.

    A title begins a section, which holds the blocks up to the next one and goes if there are none. Without any titled section
    the blocks are dealt to windows. A short untitled beginning joins the section behind it, a short section the one before while both fit,
    long ones are cut, and neighbours that fit are paired, over and over, until there are at most MAX_SECTIONS or none fit.
    """
    rendered = [b[4] or "" for b in blocks]
    filled = np.flatnonzero([bool(t.strip()) for t in rendered])
    titles = np.array([b[1] in TITLES for b in blocks], dtype=bool)
    of = np.cumsum(titles)  # which title a block belongs to; 0 stands before the first
    body = filled[~titles[filled]] if len(filled) else filled
    found = []
    for k in np.unique(of[body]) if len(body) else []:
        own = body[of[body] == k]
        head = int(np.searchsorted(of, k)) if k else None
        page = int(blocks[own[0]][0] if head is None else blocks[head][0])
        title, level = ("", 0) if head is None else ((blocks[head][2] or "").strip(), 1 if blocks[head][3] is None else blocks[head][3] or 1)
        found.append(Section(title, level, page, int(blocks[own[-1]][0]), "\n\n".join(rendered[i] for i in own)))
    if not any(s.title for s in found):
        sized = _windows(np.array([blocks[i][0] for i in filled]), [rendered[i] for i in filled])
    else:
        if len(found) > 1 and not found[0].title and len(found[0].text) < SHORT:
            found[:2] = [_joined(found[0], found[1], title=found[1].title, level=found[1].level, page_to=found[1].page_to)]
        merged: list[Section] = []
        for s in found:
            if merged and len(s.text) < SHORT and _fit(merged[-1], s):
                merged[-1] = _joined(merged[-1], s, title=merged[-1].title, level=merged[-1].level, page_from=merged[-1].page_from)
            else:
                merged.append(s)
        sized = [p for s in merged for p in _cut(s)]
        before = None
        while len(sized) > MAX_SECTIONS and len(sized) != before:
            before, pairs, i = len(sized), [], 0
            while i < before:
                two = i + 1 < before and _fit(sized[i], sized[i + 1])
                pairs.append(_joined(sized[i], sized[i + 1]) if two else sized[i])
                i += 2 if two else 1
            sized = pairs
    named = [s._replace(title=s.title or f"第 {n} 段") for n, s in enumerate(sized, 1)]
    return [s._asdict() | {"skip": bool(SKIPPED.search(s.title)), "fp": fingerprint(s.title, s.text)} for s in named]


def document_outlines(blocks: DataFrame, key: str) -> DataFrame:
    """(key, seq, title, level, page_from, page_to, text, skip, fp) from layout blocks (page, pos, type, content, and level, caption and image
    where there are any); see ``outline``. Headers, footers and page numbers are no part of it.

    One document's blocks meet in one task; documents are independent.
    """
    kept = blocks.where(~F.coalesce("type", F.lit("")).isin(*DROPPED_BLOCKS))
    level = F.col("level").cast("int") if "level" in blocks.columns else F.lit(None).cast("int")
    one = F.struct(F.col("page").cast("int").alias("page"), F.col("pos").cast("int").alias("pos"), "type", "content", level.alias("level"), block_text(kept).alias("rendered"))
    listed = kept.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("b"))

    @F.pandas_udf(OUTLINE)
    def run(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in rows:
            yield s.map(lambda bs: outline([(b["page"], b["type"], b["content"], b["level"], b["rendered"]) for b in bs]))

    return listed.select(key, F.posexplode(run("b")).alias("seq", "s")).select(key, "seq", "s.*")


def reuse_summaries(current: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Current sections with the stored summary of an equal fingerprint; ``todo`` where there is none."""
    old = stored.select(key, "fp", F.col("summary").alias("summary")).dropDuplicates([key, "fp"])
    return current.join(old, [key, "fp"], "left").withColumn("todo", F.col("summary").isNull())


def outline_status(items: DataFrame, metas: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, sections, has_file, state) from the outline JSON of each item: ready, orphan (a file only), or none."""
    n = metas.select(key, F.coalesce(F.json_array_length(F.get_json_object("v", "$.sections")), F.lit(0)).alias("sections"))
    j = items.select(key, F.lit(True).alias("__item")).join(n, key, "full_outer").join(files.select(key, F.lit(True).alias("has_file")), key, "full_outer")
    has, sections = F.coalesce("has_file", F.lit(False)), F.coalesce("sections", F.lit(0))
    return j.select(key, sections.alias("sections"), has.alias("has_file"), F.when(sections > 0, "ready").when(has, "orphan").otherwise("none").alias("state"))


def replace_formula(text: str, new: str, nth: int | None = None, old: str | None = None) -> str:
    """The nth $$ formula, or the first that holds ``old`` without regard to spaces, replaced; its \\tag stays."""
    squeeze = lambda s: re.sub(r"\s+", "", s)
    for i, m in enumerate(re.finditer(r"\$\$(.*?)\$\$", text, re.S)):
        if i == nth or (nth is None and old is not None and squeeze(old) in squeeze(m[1])):
            tag = re.search(r"\\tag\{[^}]*\}", m[1])
            body = new if not tag or "\\tag" in new else f"{new} {tag[0]}"
            return f"{text[: m.start()]}$$\n{body.strip()}\n$${text[m.end() :]}"
    return text


FORMULA = r"(?s)\$\$.*?\$\$"
TAG = r"\\tag\{[^}]*\}"


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def formula_replaced(text: Column, new: Column, nth: Column | None = None, old: Column | None = None) -> Column:
    """``replace_formula`` as an expression: the nth (from 0) $$ formula, or the first that holds ``old`` but for spaces, gets a new body and
    keeps its tag. A text without such a formula stays as it is."""
    chosen = lambda s, i: i == nth if nth is not None else _squeezed(s["found"]).contains(_squeezed(old))
    tag = lambda s: F.regexp_extract(s["found"], TAG, 0)
    body = lambda s: F.when((tag(s) == "") | new.contains("\\tag"), new).otherwise(F.concat(new, F.lit(" "), tag(s)))

    def put(t: Column, s: Column) -> Column:
        return F.when(s.isNull(), t).otherwise(F.concat(F.call_function("substring", t, F.lit(1), s["start"]), F.lit("$$\n"), strip(body(s)), F.lit("\n$$"), F.call_function("substring", t, s["end"] + 1, F.length(t))))

    return let(F.coalesce(text, F.lit("")), lambda t: let(F.get(F.filter(spans(t, FORMULA), chosen), F.lit(0)), lambda s: put(t, s)))


def formulas(pages: DataFrame, key: str, page: str = "page", text: str = "text") -> DataFrame:
    """(key, page, nth, formula, tag, start): the $$ formulas of each page in order."""
    found = pages.select(key, page, F.posexplode(spans(F.col(text), FORMULA)).alias("nth", "s"))
    inner = strip(F.regexp_replace(F.col("s.found"), r"^\$\$|\$\$$", ""))
    return found.select(key, page, "nth", inner.alias("formula"), F.nullif(F.regexp_extract(F.col("s.found"), r"\\tag\{([^}]*)\}", 1), F.lit("")).alias("tag"), F.col("s.start").alias("start"))
