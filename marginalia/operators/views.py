"""Reports, lookups and rendered views over the knowledge base's tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import scalars as sc
from marginalia.functions import text as tx

#: The levels of an item's views, from shortest to longest.
LEVELS = (("L1", "tldr", "One-paragraph summary"), ("L2", "card", "Bibliographic card"), ("L3", "outline", "Outline with section summaries"), ("L4", "figures", "Figures and tables"), ("L5", "fulltext", "Full text"), ("L6", "weight", "Weight and ledger"))


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))


def ordered(key: str, *cols: str, sort: list[str]) -> Column:
    """Aggregate: an array of structs in the order of ``sort``."""
    return F.array_sort(F.collect_list(F.struct(*sort, *[c for c in cols if c not in sort])))


def find_figures(figures: DataFrame, items: DataFrame, words: str | None = None, kind: str | None = None, key: str | None = None, limit: int = 50) -> DataFrame:
    """Figures whose text or label holds the words, of a kind or item, with the item's title; at most 200."""
    keep = F.lit(True)
    if words:
        keep = keep & (F.lower(F.coalesce("text", F.lit(""))).contains(words.lower()) | F.lower(F.coalesce("label", F.lit(""))).contains(words.lower()))
    if kind:
        keep = keep & F.col("kind").startswith(kind)
    if key:
        keep = keep & (F.col("item_key") == key)
    return figures.where(keep).join(items.select("item_key", "title"), "item_key", "left").orderBy("item_key", "page", "fig_id").limit(max(1, min(200, limit)))


def read_pages(pages: DataFrame, key: str, low: int = 1, high: int = 10**6, max_chars: int = 20_000) -> DataFrame:
    """(item_key, text, truncated): an item's pages low..high under their anchors, cut at 1000 to 120000 characters."""
    limit = max(1000, min(120_000, max_chars))
    one = F.struct("page", F.concat(F.lit("## p."), F.col("page").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("t"))
    whole = pages.where((F.col("item_key") == key) & F.col("page").between(low, high)).groupBy("item_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["t"]), "\n\n").alias("whole"))
    return whole.select("item_key", F.substring("whole", 1, limit).alias("text"), (F.length("whole") > limit).alias("truncated"))


def item_info(keys: DataFrame, items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_key, in_kb, title, year, n_chunks) for asked keys, in the knowledge base or not."""
    counts = chunks.groupBy("item_key").agg(F.count("*").alias("n"))
    known = items.select("item_key", "title", "year", F.lit(True).alias("k"))
    return keys.join(known, "item_key", "left").join(counts, "item_key", "left").select("item_key", F.coalesce("k", F.lit(False)).alias("in_kb"), "title", "year", F.coalesce("n", F.lit(0)).alias("n_chunks"))


def chunk_rows(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Chunks with their item's title and their parent's text."""
    parents = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return chunks.join(items.select("item_key", "title", "year"), "item_key").join(parents, "parent_id", "left")


def sample_page(samples: DataFrame, chunks: DataFrame) -> DataFrame:
    """(sample_id, page): the page of the first chunk of the sample's item that holds the sample's start."""
    j = samples.join(chunks, "item_key").where(F.col("text").contains(F.trim(F.substring("sample", 1, 40))))
    return j.groupBy("sample_id").agg(F.min_by("page", "seq").alias("page"))


def domain_grams(titles: DataFrame, title: str = "title", least: int = 3) -> DataFrame:
    """(gram, n): two-character CJK pieces that occur in at least ``least`` different titles: the library's own topics."""
    runs = tx.segments_cjk(F.col(title))
    grams = F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= 2), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.call_function("substring", r, i, F.lit(2)))))
    return titles.select(title).distinct().select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= least)


#: An extra's line, and how the characters of a value stand for their kind.
EXTRA_LINE = r"^\s*([A-Za-z][A-Za-z0-9 ._\-]{0,30}?)\s*[:：]\s*(.*?)\s*$"
CHARACTER_RUNS = (("[0-9]+", "9"), ("[A-Z]+", "A"), ("[a-z]+", "a"), ("[一-鿿]+", "字"), (r"(?U)\s+", " "))


def value_shape(value: Column) -> Column:
    """A value with each run of digits, capitals, small letters, CJK characters or white space as one sign, at most 40 of them."""
    out = F.coalesce(value, F.lit(""))
    for pattern, sign in CHARACTER_RUNS:
        out = F.regexp_replace(out, pattern, sign)
    return F.substring(out, 1, 40)


def key_inventory(extras: DataFrame, text: str = "extra", shapes: int = 8) -> DataFrame:
    """(key, n, filled, shape, shapes, repeated, longest): which extra keys are used and how.

    n items have the key and ``filled`` of them a value; shape is the commonest kind of value; shapes the commonest (shape, n)
    of value_shape, most first, ties to the lesser; repeated counts items in which a key stands more than once, of which the
    first counts elsewhere. Values themselves are never shown. Partial counts by (key, shape) keep the shuffle at one row for each and task.
    """
    line = F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")
    rows = extras.select(F.filter(line, lambda x: x.rlike(EXTRA_LINE)).alias("l"))
    found = F.transform("l", lambda x: F.struct(F.regexp_extract(x, EXTRA_LINE, 1).alias("key"), F.regexp_extract(x, EXTRA_LINE, 2).alias("value")))
    keyed = rows.select(found.alias("kv")).withColumn("keys", F.transform("kv", lambda x: x["key"]))
    one = F.filter(F.transform("kv", lambda x, i: F.struct(x["key"].alias("key"), x["value"].alias("value"), (F.array_position("keys", x["key"]) == i + 1).alias("first"), (F.size(F.filter("keys", lambda k: k == x["key"])) > 1).alias("again"))), lambda x: x["first"])
    flat = keyed.select(F.inline(one))
    v = F.col("value")
    kind = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").when(v.rlike(r"^-?\d+(\.\d+)?$"), "number").when(v.rlike("[;；,，]"), "list").otherwise("text")
    parts = flat.groupBy("key", kind.alias("kind"), value_shape(v).alias("s")).agg(F.count("*").alias("n"), F.count(_blank(v)).alias("filled"), F.sum(F.col("again").cast("long")).alias("again"), F.max(F.length(v)).alias("longest"))
    kinds = parts.groupBy("key", "kind").agg(F.sum("n").alias("n")).groupBy("key").agg(F.max_by("kind", F.struct("n", "kind")).alias("shape"))
    order = Window.partitionBy("key").orderBy(F.desc("n"), "s")
    by_shape = parts.groupBy("key", "s").agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= shapes)
    listed = by_shape.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "s", "n"))), lambda x: F.struct(x["s"].alias("shape"), x["n"].alias("n"))).alias("shapes"))
    counted = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("filled").alias("filled"), F.sum("again").alias("repeated"), F.max("longest").alias("longest"))
    return counted.join(kinds, "key").join(listed, "key").select("key", "n", "filled", "shape", "shapes", "repeated", "longest")


def block_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("type").agg(F.count("*").alias("n"))


def coverage_report(items: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n, total): how many rows have a value, one scan for all fields."""
    one = items.agg(F.count("*").alias("total"), *[F.count(_blank(F.col(c).cast("string"))).alias(c) for c in columns])
    return one.select("total", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("field", "n")).select("field", "n", "total")


def even_text(chunks: DataFrame) -> DataFrame:
    """(item_key, text): an item's chunks joined by page and place, parents and children alike."""
    return chunks.groupBy("item_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "seq", "text"))), lambda s: s["text"]), "\n").alias("text"))


def health_detail(health: DataFrame, chunks: DataFrame, samples: int = 3, size: int = 400) -> DataFrame:
    """Verdict and reasons with the first samples of the item's text and their pages."""
    w = Window.partitionBy("item_key").orderBy("page", "seq")
    first = chunks.withColumn("r", F.row_number().over(w)).where(F.col("r") <= samples).groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct("page", "seq", F.substring("text", 1, size).alias("text")))).alias("samples"))
    return health.join(first, "item_key", "left")


def repair_plan(health: DataFrame, pages: DataFrame) -> DataFrame:
    """Bad items with page count, size, CJK density and whether they look scanned."""
    t = F.coalesce("text", F.lit(""))
    sizes = pages.groupBy("item_key").agg(F.count("*").alias("pages"), F.sum(F.length(t)).alias("chars"), F.sum(tx.regex_count(t, f"[{tx.CJK}]")).alias("cjk"))
    j = health.where("verdict = 'bad'").join(sizes, "item_key", "left")
    density = F.col("cjk") / F.greatest(F.col("pages"), F.lit(1))
    return j.select("item_key", "pages", "chars", density.alias("density"), ((density < 30) & (F.col("chars") < 3000)).alias("scanned"))


def quality_stats(health: DataFrame) -> DataFrame:
    return health.groupBy("verdict").agg(F.count("*").alias("n"), F.max("checked_at").alias("last"))


def metadata_plan(candidates: DataFrame, writable: list[str]) -> DataFrame:
    """(item, n_apply, n_excluded): candidates (item, field, value, confidence) that are sure, filled and writable, most first."""
    apply = (F.col("confidence") == "high") & _blank(F.col("value")).isNotNull() & F.col("field").isin(*writable)
    return candidates.groupBy("item").agg(F.sum(apply.cast("int")).alias("n_apply"), F.sum((~apply).cast("int")).alias("n_excluded")).orderBy(F.desc("n_apply"), "item")


def fields_lost(fields: DataFrame, allowed: DataFrame) -> DataFrame:
    """(item, field): filled fields that the target type has no place for. fields: (item, target, fields map)."""
    filled = fields.select("item", "target", F.explode("fields").alias("field", "value")).where(_blank(F.col("value")).isNotNull())
    return filled.join(allowed.select(F.col("type").alias("target"), "field"), ["target", "field"], "left_anti").select("item", "field")


def type_fixes(items: DataFrame, paper_types: list[str]) -> DataFrame:
    return items.where((F.col("n_pdfs") > 0) & ~F.col("item_type").isin(*paper_types)).orderBy("item_key")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, keep: tuple[str, ...] = ("experience", "item_weight")) -> dict[str, DataFrame]:
    """Every derived table without the rows of deleted items; the ledger and the weights stay."""
    return {n: t if n in keep or "item_key" not in t.columns else t.join(gone.select("item_key"), "item_key", "left_anti") for n, t in tables.items()}


def collection_advice(members: DataFrame, items: DataFrame, overlaps: DataFrame, contained: DataFrame) -> DataFrame:
    """(kind, a, b): overlapping pairs, contained names, small collections and items in none; a pair is told once."""
    small = members.groupBy("collection").agg(F.count("*").alias("n")).where("n <= 2").select(F.lit("small").alias("kind"), F.col("collection").alias("a"), F.lit(None).cast("string").alias("b"))
    loose = items.join(members, "item_key", "left_anti").select(F.lit("unclassified"), F.col("item_key").cast("string"), F.lit(None).cast("string"))
    pairs = overlaps.select(F.lit("overlap"), "a", "b").union(contained.select(F.lit("contained"), "a", "b")).toDF("kind", "a", "b")
    once = pairs.withColumn("p", F.array_sort(F.array("a", "b"))).groupBy("p").agg(F.max("kind").alias("kind")).select("kind", F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"))
    return once.union(small).union(loose)


def newest(files: DataFrame, group: str, order: str, keep: int = 1) -> DataFrame:
    """The newest rows of each group: session files, backups to keep. Ties go by the other columns, in their order."""
    w = Window.partitionBy(group).orderBy(F.desc(order), *[F.col(f"`{c}`") for c in files.columns if c not in (group, order)])
    return files.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep).drop("__r")


def enrich(rows: DataFrame, key: str, sources: list[DataFrame], fields: list[str]) -> DataFrame:
    """Rows with fields from the first source that has a value; every row once, in its place. Of several values of one
    source the least counts."""
    out = rows
    for i, s in enumerate(sources):
        one = s.groupBy(key).agg(*[F.min(_blank(F.col(f))).alias(f"__{i}_{f}") for f in fields])
        out = out.join(one, key, "left")
    return out.select(*rows.columns, *[F.coalesce(*[_blank(F.col(f"__{i}_{f}")) for i in range(len(sources))]).alias(f) for f in fields])


def preflight(requests: DataFrame, limit: int) -> DataFrame:
    """Requested DOIs normalised, each once, in order, at most ``limit``; ``ok`` is false for what is no DOI."""
    doi = sc.normalize_doi(F.col("doi"))
    w = Window.partitionBy("d").orderBy("pos")
    one = requests.withColumn("d", F.when(doi == "", F.concat(F.lit("?"), F.coalesce("doi", F.lit("")))).otherwise(doi)).withColumn("r", F.row_number().over(w)).where("r = 1")
    return one.orderBy("pos").limit(limit).select("pos", doi.alias("doi"), (doi != "").alias("ok"))


def text_of_index(index: DataFrame, key: str, column: str = "index") -> DataFrame:
    """An inverted index, map of word to positions, back to text."""
    rows = index.select(key, F.explode(column).alias("word", "places")).select(key, "word", F.explode("places").alias("at"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("text"))


def evidence(text: Column, found: Column, width: int = 160, before: int = 40) -> Column:
    """A window of the text around a value that it holds; the value is never cut. Empty without it."""
    at = F.call_function("instr", text, found)
    start = F.greatest(F.lit(1), at - before)
    size = F.greatest(F.lit(width), F.length(found) + before)
    return F.when(at > 0, tx.strip(F.regexp_replace(F.call_function("substring", text, start, size), tx.SPACE, " "))).otherwise("")


def evidence_holds(text: Column, quote: Column, head: int = 24) -> Column:
    """Whether the first characters of a quotation occur in the text, white space aside."""
    squeeze = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), tx.SPACE, "")
    q = F.substring(squeeze(quote), 1, head)
    return (q != "") & squeeze(text).contains(q)


def item_view(items: DataFrame, extras: DataFrame, figures: DataFrame, notes: DataFrame, ledger: DataFrame) -> DataFrame:
    """An item with its extras, up to 60 figures, note previews and ledger entries, one row each."""
    figs = figures.groupBy("item_key").agg(F.slice(ordered("item_key", "fig_id", "kind", "label", sort=["page", "fig_id"]), 1, 60).alias("figures"))
    note = notes.groupBy("item_key").agg(F.transform(F.array_sort(F.collect_list("note")), lambda n: F.substring(n, 1, 200)).alias("notes"))
    exp = ledger.select(F.explode("item_keys").alias("item_key"), "id", "outcome", "asked").groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct("id", "outcome", "asked"))).alias("experience"))
    out = items
    for part in (extras, figs, note, exp):
        out = out.join(part, "item_key", "left")
    return out


def item_card(items: DataFrame) -> DataFrame:
    """(item_key, markdown): the card of an item; lines without a value are left out."""
    line = lambda label, c: F.when(_blank(c).isNotNull(), F.concat(F.lit(f"- **{label}**: "), c))
    body = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.lit(""), line("Authors", F.col("author_line")), line("Year", F.col("year")), line("Venue", F.col("venue")), line("DOI", F.col("doi")),
                       F.when(_blank(F.col("abstract")).isNotNull(), F.concat(F.lit("\n## Abstract\n\n"), "abstract")))
    return items.select("item_key", body.alias("markdown"))


def figure_view(figures: DataFrame, clip: int = 400) -> DataFrame:
    """(item_key, markdown): figures by page, captions clipped."""
    one = F.struct("page", "fig_id", F.concat(F.lit("- p."), F.col("page").cast("string"), F.lit(" **"), F.coalesce("label", F.lit("")), F.lit("** "), tx.clip_sentence(F.coalesce("text", F.lit("")), clip)).alias("t"))
    return figures.groupBy("item_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["t"]), "\n").alias("markdown"))


def index_list(items: DataFrame) -> DataFrame:
    """(kind, year, n, first_author, item_key, line): items listed by type and year, years descending, blank last.

    One row a line, in order: a type of very many items is never one string. ``n`` counts the items of the type and year.
    """
    kind, year = F.col("item_type").alias("kind"), F.coalesce("year", F.lit("")).alias("year")
    line = F.concat(F.lit("- "), F.coalesce("first_author", F.lit("")), F.lit(": "), F.coalesce("title", F.lit("")))
    counts = items.select(kind, year).groupBy("kind", "year").agg(F.count("*").alias("n"))
    c = counts.select(F.col("kind").alias("__k"), F.col("year").alias("__y"), "n")
    lines = items.select(kind, year, "first_author", "item_key", line.alias("line"))
    joined = lines.join(c, F.col("kind").eqNullSafe(F.col("__k")) & (F.col("year") == F.col("__y")))
    return joined.select("kind", "year", "n", "first_author", "item_key", "line").orderBy("kind", F.desc(F.col("year") != ""), F.desc("year"), "first_author", "item_key")


def source_distribution(items: DataFrame) -> DataFrame:
    """(source, n, chars): where items' whole texts come from; ``(none)`` for those without one."""
    return items.groupBy(F.coalesce("fulltext_src", F.lit("(none)")).alias("source")).agg(F.count("*").alias("n"), F.coalesce(F.sum("fulltext_chars"), F.lit(0)).cast("long").alias("chars"))


def manifest(items: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of totals."""
    parts = [items.agg(F.lit(0).alias("g"), F.count("*").alias("items"), F.sum("fulltext_chars").alias("chars")), chunks.agg(F.lit(0).alias("g"), F.count("*").alias("chunks"), F.sum(F.when(tx.indexable(F.col("level"), F.col("kind")), 1).otherwise(0)).alias("indexable")), vectors.agg(F.lit(0).alias("g"), F.count("*").alias("vectors"))]
    return parts[0].join(parts[1], "g").join(parts[2], "g").drop("g")


def invariants(chunks: DataFrame, posts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(check, ok): indexable chunks all have postings, no posting or vector without its chunk, not all texts empty."""
    need = chunks.where(tx.indexable(F.col("level"), F.col("kind"))).select("chunk_id")
    one = lambda df, name, bad: df.agg(F.lit(name).alias("check"), (F.count("*") == 0).alias("ok") if bad else (F.count("*") > 0).alias("ok"))
    return (
        one(need.join(posts.select("chunk_id"), "chunk_id", "left_anti"), "postings complete", True)
        .union(one(posts.select("chunk_id").distinct().join(chunks, "chunk_id", "left_anti"), "no stray postings", True))
        .union(one(vectors.join(chunks, "chunk_id", "left_anti"), "no stray vectors", True))
        .union(one(chunks.where(F.length(F.coalesce("text", F.lit(""))) > 0), "some text", False))
    )


def level_rows(present: DataFrame) -> DataFrame:
    """(item_key, level, name, title, present): the fixed levels of each item, with whether its file is there."""
    levels = F.array(*[F.struct(F.lit(a).alias("level"), F.lit(b).alias("name"), F.lit(c).alias("title")) for a, b, c in LEVELS])
    wanted = present.select("item_key").distinct().select("item_key", F.explode(levels).alias("l")).select("item_key", "l.*")
    return wanted.join(present.select("item_key", "level", F.lit(True).alias("p")).distinct(), ["item_key", "level"], "left").select("item_key", "level", "name", "title", F.coalesce("p", F.lit(False)).alias("present"))


def sync_actions(plan: DataFrame, live: DataFrame) -> DataFrame:
    """(name, action): planned collections against live ones, by folded name: create, keep, merge (several live), or unplanned."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    have = live.select(fold(F.col("name")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    want = plan.select(fold(F.col("name")).alias("name"), F.lit(True).alias("w")).distinct()
    n = F.coalesce("n", F.lit(0))
    return want.join(have, "name", "full_outer").select("name", F.when(F.col("w").isNull(), "unplanned").when(n == 0, "create").when(n == 1, "keep").otherwise("merge").alias("action"))


def facet_keys(extras: DataFrame, kind: str = "", tag: str = "", codes: str = "", labels: dict[str, str] | None = None) -> DataFrame:
    """(item_key): items whose extras meet every facet that is asked for.

    ``kind`` equals source_kind, or is one of ``labels`` (code to label) for it; ``tag`` is a member of the comma list
    publication_tag; each of ``codes`` begins some member of clc. Case doesn't count. Without the column that a
    facet needs no item passes: a filter that can't be read is never taken for one that all meet.
    """
    lowered = kind.strip().lower()
    want_kind = {v.lower(): k for k, v in (labels or {}).items()}.get(lowered, lowered)
    want_codes = [c.upper() for c in re.split(r"[;；,，\s]+", codes) if c]
    fold = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    members = lambda c, cut, fn: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), cut), lambda x: fn(F.trim(x)))
    asked = [("source_kind", want_kind), ("publication_tag", tag.strip()), ("clc", want_codes)]
    if any(want and c not in extras.columns for c, want in asked):
        return extras.where(F.lit(False)).select("item_key")
    keep = F.lit(True)
    if want_kind:
        keep = keep & (fold("source_kind") == want_kind)
    if tag.strip():
        keep = keep & F.array_contains(members("publication_tag", "[,，]", F.lower), tag.strip().lower())
    begins = lambda code: lambda m: m.startswith(code)
    for code in want_codes:
        keep = keep & F.exists(members("clc", r"[;；,，\s]+", F.upper), begins(code))
    return extras.where(keep).select("item_key").distinct()


#: How captions and tables are written at the end of a page.
CAPTIONS_HEAD, IMAGE_LINE, TABLE_LINE, TABLE_HEAD, TABLE_SIZE = "**本页图注**", "- 图：", "- 表：", "**本页表格 %d**", "（%d×%d）"


def page_appends(captions: DataFrame, tables: DataFrame) -> DataFrame:
    """(item_key, page, appended): markdown of a page's captions and tables, in order, for pages that have any.

    captions: (item_key, page, seq, kind, text); tables: (item_key, page, seq, rows, cols, markdown). Texts from a
    layout parser hold theirs already, so only those of the fallback source get these lines.
    """
    caps = captions.groupBy("item_key", "page").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat(F.when(F.col("kind") == "image", IMAGE_LINE).otherwise(TABLE_LINE), F.coalesce("text", F.lit(""))).alias("t")))).alias("c"))
    tabs = tables.groupBy("item_key", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "rows", "cols", F.rtrim(F.coalesce("markdown", F.lit(""))).alias("t")))).alias("g"))
    none = F.array().cast("array<string>")
    lines = F.when(F.col("c").isNotNull(), F.concat(F.array(F.lit(CAPTIONS_HEAD)), F.transform("c", lambda s: s["t"]), F.array(F.lit("")))).otherwise(none)
    grid = F.when(F.col("g").isNotNull(), F.flatten(F.transform("g", lambda s, i: F.array(F.concat(F.format_string(TABLE_HEAD, i + 1), F.format_string(TABLE_SIZE, s["rows"], s["cols"])), F.lit(""), s["t"], F.lit(""))))).otherwise(none)
    return caps.join(tabs, ["item_key", "page"], "full_outer").select("item_key", "page", F.array_join(F.concat(lines, grid), "\n").alias("appended"))
