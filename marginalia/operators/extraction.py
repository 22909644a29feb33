"""Bibliographic fields, captions and classification heuristics from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import scalars as sc
from marginalia.functions import text as tx

#: Markers of document families.
FAMILIES = {
    "thesis": (r"学位论文", r"(?i)\bthesis\b", r"(?i)\bdissertation\b", r"指导教师|导师"),
    "conference": (r"(?i)\bproceedings\b", r"(?i)\bconference\b", r"(?i)\bsymposium\b", r"会议"),
    "journal": (r"(?i)\bjournal\b", r"(?i)\bvol\.?\s*\d+", r"(?i)\bissn\b", r"学报|期刊"),
}


def extract_doi(text: Column) -> Column:
    """The first DOI, strictly written, else with spaces inside; normalised."""
    t = F.coalesce(text, F.lit(""))
    strict = F.regexp_extract(t, r"\b(10\.\d{4,9}/[^\s\"'<>，。；）\])]+)", 1)
    loose = F.regexp_replace(F.regexp_extract(t, r"(?i)doi\s*[:：]?\s*(10\s*\.\s*\d{4,9}\s*/\s*\S+)", 1), r"\s+", "")
    return sc.normalize_doi(F.coalesce(F.nullif(strict, F.lit("")), loose))


def document_family(text: Column) -> Column:
    """struct(family, sure): the family with most distinct markers; ties go conference, journal, thesis; sure if it alone has two or more."""
    n = {f: sum((F.coalesce(text, F.lit("")).rlike(p).cast("int") for p in ps), F.lit(0)) for f, ps in FAMILIES.items()}
    best = F.greatest(*n.values())
    family = F.when(best == 0, F.lit(None).cast("string")).when(n["conference"] == best, "conference").when(n["journal"] == best, "journal").otherwise("thesis")
    return F.struct(family.alias("family"), ((best >= 2) & (sum(((v > 0).cast("int") for v in n.values()), F.lit(0)) == 1)).alias("sure"))


CAPTION = r"^(?i)\s*((?:Fig(?:ure)?|Tab(?:le)?)\.?\s*\d+(?:[.\-]\d+)*|[图表]\s*\d+(?:[.\-]\d+)*)[.:：\s]+(\S.*)$"


def captions(pages: DataFrame, key: str, page: str = "page", text: str = "text") -> DataFrame:
    """(key, page, kind, label, caption): lines that begin a caption, one more line if it goes on; contents lines are left out; repeats of the first 60 characters go."""
    rows = pages.select(key, page, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    after = F.lead("line").over(Window.partitionBy(key, page).orderBy("pos"))
    found = rows.withColumn("after", F.coalesce(after, F.lit(""))).where(F.col("line").rlike(CAPTION) & ~F.col("line").rlike(r"\.{2,}\s*\d+\s*$|…{2,}"))
    goes_on = ~F.col("line").rlike(r"[.。!?！？]\s*$") & (F.trim("after") != "") & ~F.col("after").rlike(CAPTION)
    label = F.regexp_replace(F.regexp_extract("line", CAPTION, 1), r"\s+", " ")
    body = F.trim(F.concat(F.regexp_extract("line", CAPTION, 2), F.when(goes_on, F.concat(F.lit(" "), F.trim("after"))).otherwise("")))
    out = found.select(key, page, "pos", F.when(label.rlike(r"(?i)^fig|^图"), "figure").otherwise("table").alias("kind"), label.alias("label"), body.alias("caption")).where(F.length("caption") >= 6)
    w = Window.partitionBy(key, F.substring("caption", 1, 60)).orderBy(page, "pos")
    return out.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, page, "kind", "label", "caption")


def table_usable(rows: Column) -> Column:
    """array<array<string>> cells: at least 2 x 2 and 30 % filled."""
    cells = F.flatten(rows)
    filled = F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    return (F.size(rows) >= 2) & (F.array_max(F.transform(rows, lambda r: F.size(r))) >= 2) & (filled / F.greatest(F.size(cells), F.lit(1)) >= 0.3)


def table_markdown(rows: Column) -> Column:
    """Pipe table; short rows are padded."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), r"\|", "/")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: clean(F.get(r, i))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    return F.array_join(F.concat(F.transform(F.slice(rows, 1, 1), line), F.array(rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(0))), line)), "\n")


#: Block types that are no part of a text.
DROPPED_BLOCKS = ("header", "footer", "page_footnote", "page_number", "page_header", "page_footer")


def block_text(blocks: DataFrame) -> Column:
    """A layout block's text: titles with their marks, formulas between $$, images and tables with their captions; empty for other parts."""
    has = lambda c, none: F.coalesce(F.col(c), F.lit(none)) if c in blocks.columns else F.lit(none)
    kind, c, cap, image = F.coalesce("type", F.lit("")), F.trim(F.coalesce("content", F.lit(""))), F.trim(has("caption", "")), F.trim(has("image", ""))
    depth = F.least(F.greatest(has("level", 1).cast("int") + 1, F.lit(2)), F.lit(6))
    picture = F.concat_ws("\n", F.when(image != "", F.concat(F.lit("!["), F.when(cap != "", cap).otherwise(kind), F.lit("]("), image, F.lit(")"))), F.when(cap != "", cap).when((c != "") & (c != image), c))
    return (
        F.when(kind.isin(*DROPPED_BLOCKS), "")
        .when(kind.isin("doc_title", "title"), F.concat(F.lit("# "), c))
        .when(kind.isin("paragraph_title", "section_title", "heading"), F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), c))
        .when(kind.isin("equation", "interline_equation", "inline_equation", "formula"), F.when(c != "", F.concat(F.lit("$$"), c, F.lit("$$"))).otherwise(""))
        .when(kind.isin("image", "chart", "figure"), picture)
        .when(kind == "table", F.concat_ws("\n\n", F.nullif(cap, F.lit("")), F.when(c != "", c).when(image != "", F.concat(F.lit("!["), F.when(cap != "", cap).otherwise("表"), F.lit("]("), image, F.lit(")")))))
        .otherwise(c)
    )


def render_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """(key, page, text): layout blocks (page, pos, type, content, level, caption, image) to page text."""
    return blocks.withColumn("t", block_text(blocks)).where("t <> ''").groupBy(key, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]), "\n\n").alias("text"))


def item_health(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``verdict``: bad, unsure or ok for a whole document, Latin texts by their common words too. A Latin
    text with few common words that has many once its characters are shifted is bad; only such suspects are shifted."""
    counted = tx.with_char_stats(docs, text, words=True)
    s = {n: F.col(n) for n in ("total", "exotic_ratio", "cjk_ratio", "latin_ratio")}
    rules = tx.text_verdict(s)
    foreign = (s["latin_ratio"] >= 0.5) & (F.col("__words") >= 200) & (F.col("__common") < 0.12)
    found = tx.best_shift(F.when(foreign, F.col(text)))
    moved = counted.withColumn("__shift", found)
    shifted = foreign & (F.col("__shift.shift") != 0) & tx.shift_accepted(F.col("__common"), F.col("__words"), s["latin_ratio"], F.col("__shift.ratio"))
    verdict = F.when(s["total"] < 200, "bad").when(rules == "bad", "bad").when(shifted, "bad").when(rules == "unsure", "unsure").when(foreign, "unsure").otherwise("ok")
    return moved.withColumn("verdict", verdict).select(*docs.columns, "verdict")


def scanned(cjk_per_page: Column, chars: Column) -> Column:
    return (cjk_per_page < 30) & (chars < 3000)
