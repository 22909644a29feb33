"""Hand edits of pages: line patches against the machine's text, and a log of edits that can be walked back.

The log is append-only: rows (key, page, version, text, base, at), one for each save or restore of a page. A null text says
that the page shows the machine's text again. ``base`` is the hash of the machine's page that the edit was made on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PATCH = "array<struct<at:int,gone:int,lines:array<string>>>"
#: Beyond so many differing lines the middle of a page is replaced whole: right, but not the shortest patch.
MOST_STEPS = 2000
HASH_CHARS = 16


def _common_lines(a: list[str], b: list[str], most: int) -> list[tuple[int, int]]:
    """Pairs of equal lines on a shortest edit path from ``a`` to ``b`` (a longest common subsequence); [] beyond ``most`` steps.

    The furthest reach on each diagonal, step by step; the reaches of all steps are kept to walk the path back.
    """
    reach, kept = {1: 0}, []
    for step in range(min(most, len(a) + len(b)) + 1):
        kept.append(dict(reach))
        for k in range(-step, step + 1, 2):
            down = k == -step or (k != step and reach[k - 1] < reach[k + 1])
            i = reach[k + 1] if down else reach[k - 1] + 1
            while i < len(a) and i - k < len(b) and i >= 0 and a[i] == b[i - k]:
                i += 1
            reach[k] = i
            if i >= len(a) and i - k >= len(b):
                break
        else:
            continue
        break
    else:
        return []
    pairs, i, j = [], len(a), len(b)
    for step in range(len(kept) - 1, -1, -1):
        k, was = i - j, kept[step]
        before = k + 1 if k == -step or (k != step and was[k - 1] < was[k + 1]) else k - 1
        pi = was[before] if step else 0
        pj = pi - before if step else 0
        while i > pi and j > pj:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        i, j = pi, pj
    return pairs[::-1]


def line_patch(old: str, new: str, most: int = MOST_STEPS) -> list[tuple[int, int, list[str]]]:
    """(at, gone, lines): from line ``at`` of the old text on, ``gone`` lines make place for ``lines``."""
    a, b = old.split("\n"), new.split("\n")
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    out, i, j = [], 0, 0
    for pi, pj in [*_common_lines(mid_a, mid_b, most), (len(mid_a), len(mid_b))]:
        if pi > i or pj > j:
            out.append((head + i, pi - i, mid_b[j:pj]))
        i, j = pi + 1, pj + 1
    return out


def page_diff(machine: DataFrame, edited: DataFrame, keys: list[str], most: int = MOST_STEPS) -> DataFrame:
    """(keys, patch): how to get from the machine's page to the edited one, by lines; empty where they are equal.

    Only pages that both have are compared; null texts are empty. One page meets its edit in one shuffle by ``keys``; a patch is
    made in Arrow batches.
    """
    both = machine.select(*keys, F.coalesce("text", F.lit("")).alias("old")).join(edited.select(*keys, F.coalesce("text", F.lit("")).alias("new")), keys)

    @F.pandas_udf(PATCH)
    def patches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for old, new in batches:
            yield pd.Series([[{"at": at, "gone": gone, "lines": lines} for at, gone, lines in line_patch(a, b, most)] for a, b in zip(old, new)])

    return both.select(*keys, F.when(F.col("old") == F.col("new"), F.array().cast(PATCH)).otherwise(patches("old", "new")).alias("patch"))


def patched(text: Column, patch: Column) -> Column:
    """A text with a patch applied."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"), lines.alias("lines"))

    def on(s: Column, p: Column) -> Column:
        return F.struct((p["at"] + p["gone"]).alias("at"), F.concat(s["out"], F.slice(s["lines"], s["at"] + 1, p["at"] - s["at"]), p["lines"]).alias("out"), s["lines"].alias("lines"))

    return F.aggregate(patch, start, on, lambda s: F.array_join(F.concat(s["out"], F.slice(s["lines"], s["at"] + 1, F.greatest(F.size(s["lines"]) - s["at"], F.lit(0)))), "\n"))


def page_hash(text: Column) -> Column:
    return F.substring(F.sha1(F.coalesce(text, F.lit(""))), 1, HASH_CHARS)


def current_edits(log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, version, text, base, at): the newest row of each page, without pages that show the machine's text."""
    newest = log.groupBy(*keys).agg(F.max_by(F.struct("version", "text", "base", "at"), "version").alias("e"))
    return newest.select(*keys, "e.*").where("text IS NOT NULL")


def _appended(log: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, text, base, at) under the next version of their page."""
    last = log.groupBy(*keys).agg(F.max("version").alias("__last"))
    return rows.join(last, keys, "left").select(*keys, (F.coalesce("__last", F.lit(0)) + 1).cast("int").alias("version"), "text", "base", "at")


def save_pages(log: DataFrame, machine: DataFrame, pages: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """New log rows for edited pages (keys, text), based on the machine's pages as they are now.

    Pages that are the machine's text but for empty lines at both ends end their edit, and need no row if there is none;
    pages that are as they were last saved give none either. A page that the machine hasn't got has an empty base.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\n+|\n+$", "")
    now = current_edits(log, keys).select(*keys, F.col("text").alias("__now"))
    known = machine.select(*keys, F.col("text").alias("__machine"), F.lit(True).alias("__known"))
    j = pages.select(*keys, F.coalesce("text", F.lit("")).alias("__new")).join(known, keys, "left").join(now, keys, "left")
    same = F.col("__known").isNotNull() & (bare(F.col("__new")) == bare(F.col("__machine")))
    changed = j.where(F.when(same, F.col("__now").isNotNull()).otherwise(~F.col("__now").eqNullSafe(F.col("__new"))))
    rows = changed.select(*keys, F.when(~same, F.col("__new")).alias("text"), F.when(F.col("__known"), page_hash(F.col("__machine"))).otherwise("").alias("base"), F.lit(at).alias("at"))
    return _appended(log, rows, keys)


def restore_pages(log: DataFrame, wanted: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """New log rows that bring pages back: wanted has (keys, version), the version whose text is to show again, 0 for the machine's.

    Pages that show that text already, and versions that a page never had, give no row.
    """
    now = current_edits(log, keys).select(*keys, F.col("text").alias("__now"))
    old = log.select(*keys, "version", "text", "base")
    j = wanted.select(*keys, "version").join(old, [*keys, "version"], "left").where("version = 0 OR base IS NOT NULL").join(now, keys, "left")
    rows = j.where(~F.col("text").eqNullSafe(F.col("__now"))).select(*keys, "text", F.coalesce("base", F.lit("")).alias("base"), F.lit(at).alias("at"))
    return _appended(log, rows, keys)


def save_draft(log: DataFrame, machine: DataFrame, drafts: DataFrame, at: str, key: str) -> DataFrame:
    """Log rows for whole documents that come back from an editor with ``## p.N`` anchors, page by page: (key, text)."""
    from marginalia.sources.files import parse_page_anchors

    return save_pages(log, machine, parse_page_anchors(drafts, key), at, [key, "page"])


def edit_status(log: DataFrame, machine: DataFrame, keys: list[str], key: str) -> DataFrame:
    """(key, edited, stale, version, at): pages with an edit, those whose machine text changed since, the number of log rows and the last time."""
    now = machine.select(*keys, page_hash(F.col("text")).alias("__hash"))
    j = current_edits(log, keys).join(now, keys, "left")
    stale = (F.col("base") != "") & F.col("__hash").isNotNull() & (F.col("base") != F.col("__hash"))
    page = next(k for k in keys if k != key)
    pages = j.groupBy(key).agg(F.array_sort(F.collect_list(page)).alias("edited"), F.array_sort(F.collect_list(F.when(stale, F.col(page)))).alias("stale"), F.max("at").alias("at"))
    return pages.join(log.groupBy(key).agg(F.count("*").alias("version")), key)
