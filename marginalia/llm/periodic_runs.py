"""Periodic runs of words, found in the suffix tree of each text.

A branching tandem repeat is a square (a word sequence twice over) that doesn't continue: the word after it differs from the
word after its first half. Both halves start suffixes that part at the tree node whose depth is the half's length, so walking
the leaf list of the smaller side of every node finds all of them in O(n log n) (Stoye and Gusfield). Each is then rotated to
the left as far as it goes, and rotations of one stretch are merged into the maximal run of its smallest period.

The tree of a pass's texts is held as suffix order, common prefix lengths and the interval of each binary node; no suffix of
one text is compared with another text's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MIN_WORDS, MIN_EXPONENT = 24, 3
#: Texts are taken together up to this many words; a longer text makes a pass of its own. Memory is about 300 bytes a word.
PASS_WORDS = 200_000
#: Leaves looked at together while the tree is walked.
LEAVES = 1 << 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def _ranks(tokens: np.ndarray, doc: np.ndarray, last: np.ndarray, bound: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions that stay, and for each doubling the rank of every suffix by its first 1, 2, 4 ... words (from 1; 0 stands
    for what lies behind the end).

    A text in which no ``bound`` words occur twice has no run and leaves as soon as that shows.
    """
    kept = np.arange(len(tokens))
    levels = [np.unique(doc * (int(tokens.max()) + 1) + tokens, return_inverse=True)[1] + 1]
    width = 1
    while True:
        often = np.bincount(levels[-1])[levels[-1]] > 1
        if width <= bound:
            alive = np.zeros(int(doc.max()) + 1, dtype=bool)
            alive[doc[often]] = True
            stay = alive[doc]
            if not stay.all():
                # texts leave whole, so neighbours stay neighbours
                kept, doc, last, often = kept[stay], doc[stay], last[stay] - np.cumsum(~stay)[stay], often[stay]
                levels = [level[stay] for level in levels]
        if not often.any():
            return kept, levels
        at = np.arange(len(kept)) + width
        ahead = np.where(at < last, levels[-1][np.minimum(at, len(kept) - 1)], 0)
        levels.append(np.unique(levels[-1] * (len(tokens) + 2) + ahead, return_inverse=True)[1] + 1)
        width *= 2


def _common(order: np.ndarray, last: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many first words each suffix shares with the one before it in order (0 for the first)."""
    a, b = order[:-1].copy(), order[1:].copy()
    end_a, end_b = last[a], last[b]
    found = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        equal = (a < end_a) & (b < end_b)
        equal &= levels[k][np.minimum(a, len(order) - 1)] == levels[k][np.minimum(b, len(order) - 1)]
        step = equal * (1 << k)
        a += step
        b += step
        found += step
    return np.concatenate([[0], found])


def _intervals(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place between two suffixes, the leaves of the binary tree node there: from ``low`` up to but without
    ``high``. A node of several children becomes a chain of binary ones, which part the same pairs of leaves: the place
    of a later child holds those of the earlier ones."""
    values = common.tolist()
    n = len(values)
    low, high = [0] * n, [n] * n
    stack: list[int] = []
    for i, value in enumerate(values):
        while stack and values[stack[-1]] >= value:
            high[stack.pop()] = i
        low[i] = stack[-1] if stack else 0
        stack.append(i)
    return np.array(low), np.array(high)


def _squares(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of all branching tandem repeats."""
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    low, high = _intervals(common)
    nodes = np.flatnonzero(common > 0)
    starts, halves = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    left, right = nodes - low[nodes], high[nodes] - nodes
    small_left = left <= right
    size = np.minimum(left, right)
    first = np.where(small_left, low[nodes], nodes)
    other_low, other_high = np.where(small_left, nodes, low[nodes]), np.where(small_left, high[nodes], nodes)
    total = np.cumsum(size)
    at = 0
    while at < len(nodes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LEAVES, "right")))
        node = np.repeat(np.arange(at, to), size[at:to])
        within = np.arange(len(node)) - np.repeat(total[at:to] - size[at:to] - (total[at - 1] if at else 0), size[at:to])
        leaf = order[first[node] + within]
        half = common[nodes[node]]
        for partner in (leaf + half, leaf - half):
            inside = (partner >= 0) & (partner < len(order))
            where = place[np.clip(partner, 0, len(order) - 1)]
            hit = inside & (where >= other_low[node]) & (where < other_high[node])
            starts.append(np.minimum(leaf, partner)[hit])
            halves.append(half[hit])
        at = to
    return np.concatenate(starts), np.concatenate(halves)


def _rotated(tokens: np.ndarray, start: int, period: int, floor: int) -> int:
    """How far to the left the repeat at ``start`` goes on, at most to ``floor``: compared in blocks that double."""
    block = 16
    while start > floor:
        begin = max(floor, start - block)
        differ = np.flatnonzero(tokens[begin:start] != tokens[begin + period : start + period])
        if len(differ):
            return begin + int(differ[-1]) + 1
        start, block = begin, block * 2
    return start


def find_runs(tokens: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """For each of the texts that lie behind one another in ``tokens``, its runs (start, length, period) by start and period.

    A run has at least ``min_words`` words and ``min_exponent`` periods (2 or more).
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    if not len(tokens):
        return out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    # start and start + period of a run share at least this many words
    bound = max(1, -(-min_words * (min_exponent - 1) // min_exponent))
    kept, levels = _ranks(tokens, doc, np.repeat(ends, sizes), bound)
    if not len(kept):
        return out
    tokens, doc = tokens[kept], doc[kept]
    edge = np.searchsorted(doc, doc, "right")
    begin = np.searchsorted(doc, doc, "left")
    order = np.empty(len(kept), dtype=np.int64)
    order[levels[-1] - 1] = np.arange(len(kept))
    start, half = _squares(order, _common(order, edge, levels))
    need = np.maximum(min_words - 2 * half, (min_exponent - 2) * half)
    far = start - np.maximum(need, 0)
    could = (far >= begin[start]) & (tokens[np.maximum(far, 0)] == tokens[np.maximum(far, 0) + half])
    end = start + 2 * half
    chosen = np.flatnonzero(could)
    chosen = chosen[np.lexsort((half[chosen], end[chosen]))]
    at_end, found = -1, []
    for i in chosen.tolist():
        e, d, s = int(end[i]), int(half[i]), int(start[i])
        if e != at_end:
            at_end, found = e, []
        if any(d % q == 0 and e - 2 * d >= first for first, q in found):
            continue
        s = _rotated(tokens, s, d, int(begin[s]))
        if e - s >= max(min_words, min_exponent * d):
            found.append((s, d))
            out[int(doc[s])].append((s - int(begin[s]), e - s, d))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that stand in no run behind its first period, joined by one space."""
    if not runs:
        return " ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return " ".join(w for w, k in zip(words, keep.tolist()) if k)


def _passes(texts: list[str | None]) -> Iterator[list[list[str]]]:
    group: list[list[str]] = []
    total = 0
    for text in texts:
        words = WORD.findall(text or "")
        if group and total + len(words) > PASS_WORDS:
            yield group
            group, total = [], 0
        group.append(words)
        total += len(words)
    yield group


def _label(names: list[str], min_words: int, min_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            runs, collapsed = [], []
            for group in _passes(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                flat = np.array([w for words in group for w in words], dtype=object)
                found = find_runs(pd.factorize(flat)[0].astype(np.int64) if len(flat) else np.empty(0, dtype=np.int64), np.array([len(w) for w in group], dtype=np.int64), min_words, min_exponent)
                runs += [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
                collapsed += [collapse(w, r) for w, r in zip(group, found)]
            made = {"runs": pa.array(runs, kind), "collapsed": pa.array(collapsed, pa.string())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)

    return run


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Every row of ``docs`` with ``runs``, the maximal periodic runs of its words by start and period, and ``collapsed``, the
    text with one period of each run.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of at least ``min_words`` words and
    ``min_exponent`` times its smallest period that can't be extended. Null and empty texts have no runs and collapse to the
    empty string. Repeated rows are treated each for itself; ids aren't used. Input columns named ``runs`` or
    ``collapsed`` are replaced, others pass through. An empty table gives an empty table. Texts of any length are read whole.
    """
    docs = docs.drop("runs", "collapsed")
    schema = T.StructType([*docs.schema.fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    return docs.mapInArrow(_label(schema.names, min_words, min_exponent), schema)
