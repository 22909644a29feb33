"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at
most three bits differ in at most one bit in one of the segments, so each fingerprint looks up
the Hamming ball of radius one around each of its segments. Of two segments that differ in one
bit only the one without that bit looks up the other: a ball costs 16 look-ups on average.
Candidates of a table entry are verified on all 64 bits.

Equal fingerprints are collapsed before the search. Entries are searched breadth first and every
fingerprint found leaves the search at once, so a large family of near copies gives a spanning
forest, not all of its pairs. An entry of more than WIDE_ENTRY fingerprints is not searched by the task
that meets it: its fingerprints are dealt out again by two pieces of 16 bits of the half that they don't
share, one of which differs in at most one bit for any linked pair. Components are found without the
driver (see components.py).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.components import components
from marginalia.llm.shared import one_of_each, packed, stored, unpacked, with_text_key

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: Entries of more fingerprints than this are dealt out again by 16-bit pieces before they are searched.
WIDE_ENTRY = 4096
#: Names a document: rows that repeat an id are told apart by their texts.
KEY = ["__bare", "__id", "__text"]


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words: zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])), dtype=np.uint64, count=len(words) - width + 1)
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = hashes[start : start + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(4).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found.view(np.int64))], names=["doc_id", *KEY, "__fp"])

    return run


def _forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest over fingerprints at most ``radius`` bits apart."""
    links: list[tuple[int, int]] = []
    rest = np.unique(fps)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                links += [(int(x), int(y)) for y in found]
                queue += list(found)
    return links


def _link_entries(limit: int | None):
    """Rows (key, fp, home) come sorted by key. An entry is searched when its last row is in; out go its links
    (u, v). The fingerprints of an entry of more than ``limit`` go out as they come, as (u, null, key)."""

    def wide(key: int, fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64()), pa.array(np.full(len(fps), key, dtype=np.int64))], names=["u", "v", "key"])

    def search(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[heads, len(key)])
        homes = np.add.reduceat(home.astype(np.int64), heads)
        links: list[tuple[int, int]] = []
        for at, n in zip(heads[(sizes > 1) & (homes > 0)], sizes[(sizes > 1) & (homes > 0)]):
            if limit and n > limit:
                yield wide(int(key[at]), fp[at : at + n])
            else:
                links += _forest(fp[at : at + n])
        if links:
            pairs = np.array(links, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], names=["u", "v", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        spread = None
        for batch in batches:
            key, fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.view(np.uint64)
            if spread is not None:
                more = int(np.searchsorted(key, spread, side="right"))
                if more:
                    yield wide(spread, fp[:more])
                key, fp, home = key[more:], fp[more:], home[more:]
            if not len(key):
                continue
            spread = None
            held.append((key, fp, home))
            if key[-1] != held[0][0][0]:
                key, fp, home = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(key, key[-1], side="left"))
                held = [(key[cut:], fp[cut:], home[cut:])]
                yield from search(key[:cut], fp[:cut], home[:cut])
            if limit and sum(len(x[1]) for x in held) > limit:
                spread = int(held[0][0][0])
                for _, fps, _ in held:
                    yield wide(spread, fps)
                held = []
        if held:
            yield from search(*(np.concatenate(x) for x in zip(*held)))

    return run


def _ball(value: Column, width: int, key) -> Column:
    """(key, home) of a value and of the values with one more bit set, which look up from below."""
    one = F.lit(1).cast("long")
    unset = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.call_function("shiftright", value, b).bitwiseAND(one) == 0)
    return F.concat(F.array(F.struct(key(value).alias("key"), F.lit(True).alias("home"))),
                    F.transform(unset, lambda b: F.struct(key(value + F.call_function("shiftleft", one, b)).alias("key"), F.lit(False).alias("home"))))


def _searched(entries: DataFrame, limit: int | None) -> DataFrame:
    return entries.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_link_entries(limit), "u long, v long, key long")


def fingerprint_links(fps: DataFrame, wide_entry: int = WIDE_ENTRY) -> DataFrame:
    """Links (u, v) that connect every two fingerprints (``__fp``, distinct) within RADIUS bits."""
    halves = [F.col("__fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("__fp", 32)]
    entries = None
    for segment, half in enumerate(halves):
        tag = lambda v, s=segment: v + F.lit(s << 32).cast("long")
        found = fps.select("__fp", half.alias("value")).select(F.col("__fp").alias("fp"), F.explode(_ball(F.col("value"), 32, tag)).alias("e")).select("e.key", "fp", "e.home")
        entries = found if entries is None else entries.union(found)
    first = stored(_searched(entries, wide_entry), "fingerprint-links")
    wide = first.where("v IS NULL").select("key", F.col("u").alias("fp"))
    if wide.isEmpty():
        return first.select("u", "v")
    # the other half's lower and upper piece
    other = F.when(F.shiftrightunsigned("key", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    pieces = F.explode(F.array(F.struct(F.lit(0).alias("piece"), other.bitwiseAND(F.lit(0xFFFF)).alias("value")), F.struct(F.lit(1).alias("piece"), F.shiftrightunsigned(other, 16).alias("value"))))
    dealt = wide.select("key", "fp", pieces.alias("p")).select("key", "fp", "p.piece", "p.value")
    named = lambda v: F.xxhash64(F.col("key"), F.col("piece"), v)
    again = dealt.select("fp", F.explode(_ball(F.col("value"), 16, named)).alias("e")).select("e.key", "fp", F.lit(True).alias("home"))
    return first.where("v IS NOT NULL").select("u", "v").union(_searched(again, None).select("u", "v"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint, component_id, is_kept, __bare, __id, __text.

    Words are runs of characters other than ASCII white space, A-Z lowered. Texts of fewer than
    ``width`` words are one shingle; null, empty and blank texts have the fingerprint zero and
    are linked like any other. component_id is the smallest doc_id reachable; null where no
    linked row has an id. ``is_kept`` marks the one document of a component that stays: that id,
    or, without any id, the row with the smallest hash of its text. Rows that repeat an id are
    one document if their texts are equal. Columns other than doc_id and text are not used. An
    empty table gives an empty table.
    """
    rows = stored(with_text_key(docs.select("doc_id", "text")).select("doc_id", *KEY, "text").mapInArrow(_fingerprint_rows(width), "doc_id long, __bare boolean, __id long, __text long, __fp long"), "fingerprints")
    classes = stored(rows.groupBy("__fp").agg(F.min(F.struct(*KEY)).alias("__lead")), "fingerprint-classes")
    stars = components(fingerprint_links(classes.select("__fp")))
    members = stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
    found = members.join(classes, members.node == classes["__fp"]).groupBy("root").agg(F.min("__lead").alias("__found"))
    leads = stored(members.join(found, "root").select(F.col("node").alias("__fp"), "__found"), "component-leads")
    named = stored(classes.join(leads, "__fp", "left").select("__fp", F.coalesce("__found", "__lead").alias("__lead")), "components")
    return rows.join(named, "__fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
        F.when(~F.col("__lead.__bare"), F.col("__lead.__id")).alias("component_id"),
        (F.col("__lead") == F.struct(*KEY)).alias("is_kept"),
        *KEY,
    )


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id, or, where none has an id, with the
    smallest hash of its text. Null, empty and blank texts are copies of each other; rows that repeat an id are
    one document only if their texts are equal, and then one of them stays. Texts of any length are read
    whole. Other columns pass through, whatever their names. An empty table gives an empty table.
    """
    kept = near_duplicates(docs, width).where("is_kept").select(*KEY).distinct()
    return unpacked(one_of_each(with_text_key(packed(docs, "doc_id", "text")).join(kept, KEY, "left_semi"), KEY), docs.columns, "doc_id", "text")
