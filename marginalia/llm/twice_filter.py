"""Once-seen and twice-seen Bloom filters over digests, by which only suspected repeats are shuffled.

A table of digests has a row for each document with its distinct 16-byte digests in one binary. Every
task notes in two bitmaps which bits it has set once and which again; the bitmaps' set bits are merged by
segment: a bit is in the twice-filter if two tasks, or one task twice, have set it. No digest of two
documents can be missing from it. The filter is broadcast, and a second pass over the digest table (not
the texts) sends on what passes.

A filter has at most ``max_bits`` bits, whatever the input: where the digests, which are counted, ask for more,
they are dealt to ranges by their leading bits and each range has a filter and a pass of its own. So the
filters never fill up, and a task holds ``max_bits`` / 4 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import stored

MIN_BITS, MAX_BITS = 1 << 20, 1 << 29
BITS_A_DIGEST = 14
PROBES = 3
SEGMENT_BITS = 16
SEGMENT_BYTES = (1 << SEGMENT_BITS) // 8
#: Digests looked at together.
PORTION = 1 << 17
#: Rows sent on together.
SENT_ROWS = 50_000


def as_words(digests: bytes) -> np.ndarray:
    """16-byte digests as rows of two 64-bit numbers."""
    return np.frombuffer(digests, dtype="<u8").reshape(-1, 2)


def range_of(words: np.ndarray, ranges: int) -> np.ndarray:
    return ((words[:, 1] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def filter_positions(words: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions for each digest, one row per digest."""
    step = words[:, 1] | np.uint64(1)
    return np.stack([(words[:, 0] + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)], axis=1)


def in_filter(packed_bits: np.ndarray, bits: int, words: np.ndarray) -> np.ndarray:
    """Which digests have all their bits set."""
    at = filter_positions(words, bits)
    return ((packed_bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _set(packed_bits: np.ndarray, at: np.ndarray, mask: np.ndarray) -> None:
    if len(at):
        heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        packed_bits[at[heads]] |= np.bitwise_or.reduceat(mask, heads)


class Noted:
    """The bits set once and those set again, as two bitmaps of a fixed size."""

    def __init__(self, bits: int):
        self.once, self.twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)

    def add(self, places: np.ndarray) -> None:
        seen, counts = np.unique(places, return_counts=True)
        at, mask = (seen >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (seen & np.uint64(7))).astype(np.uint8)
        again = (counts > 1) | ((self.once[at] & mask) != 0)
        _set(self.once, at, mask)
        _set(self.twice, at[again], mask[again])


def _segments(packed_bits: np.ndarray, twice: bool) -> Iterator[pa.RecordBatch]:
    """The set bits of a bitmap as rows of (segment, twice, offsets)."""
    step = 512 * SEGMENT_BYTES
    for start in range(0, len(packed_bits), step):
        part = packed_bits[start : start + step]
        held = np.flatnonzero(part)
        if not len(held):
            continue
        rows, bit = np.nonzero(np.unpackbits(part[held, None], axis=1, bitorder="little"))
        places = held[rows] * 8 + bit
        segments = places >> SEGMENT_BITS
        heads = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1]])
        parts = np.split((places & ((1 << SEGMENT_BITS) - 1)).astype("<u2"), heads[1:])
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array((segments[heads] + start // SEGMENT_BYTES).astype(np.int32)), "twice": pa.array([twice] * len(parts)),
            "offsets": pa.array([p.tobytes() for p in parts], pa.binary()),
        })


def _portions(blobs: list[bytes | None], ranges: int, which: int) -> Iterator[np.ndarray]:
    """The digests of a range, many documents at once."""
    held, n = [], 0
    for blob in blobs:
        if blob:
            held.append(blob)
            n += len(blob) // 16
        if n >= PORTION:
            words = as_words(b"".join(held))
            yield words if ranges == 1 else words[range_of(words, ranges) == which]
            held, n = [], 0
    if held:
        words = as_words(b"".join(held))
        yield words if ranges == 1 else words[range_of(words, ranges) == which]


def _note(bits: int, ranges: int, which: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noted = Noted(bits)
        for batch in batches:
            for words in _portions(batch.column(0).to_pylist(), ranges, which):
                noted.add(filter_positions(words, bits).ravel())
        yield from _segments(noted.once, False)
        yield from _segments(noted.twice, True)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by segment. Out goes each segment's twice-seen bits: those that two tasks, or one task twice, have set."""
    now, once, twice = None, np.zeros(1 << SEGMENT_BITS, dtype=bool), np.zeros(1 << SEGMENT_BITS, dtype=bool)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"segment": pa.array([now], pa.int32()), "bitmap": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    for batch in batches:
        for segment, doubled, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if segment != now:
                if now is not None and twice.any():
                    yield row()
                now = segment
                once[:] = False
                twice[:] = False
            at = np.frombuffer(raw, dtype="<u2")
            if doubled:
                twice[at] = True
            else:
                twice[at[once[at]]] = True
                once[at] = True
    if now is not None and twice.any():
        yield row()


def twice_filter(digests: DataFrame, bits: int, ranges: int = 1, which: int = 0) -> np.ndarray:
    """The twice-seen filter of one range of digests, as packed bits. What reaches the driver is at most ``bits`` / 8 bytes."""
    noted = digests.select("digests").mapInArrow(_note(bits, ranges, which), "segment int, twice boolean, offsets binary")
    merged = noted.repartition(F.col("segment")).sortWithinPartitions("segment").mapInArrow(_merge, "segment int, bitmap binary")
    found = np.zeros(bits // 8, dtype=np.uint8)
    for row in merged.toLocalIterator(prefetchPartitions=True):
        found[row.segment * SEGMENT_BYTES : (row.segment + 1) * SEGMENT_BYTES] = np.frombuffer(bytes(row.bitmap), dtype=np.uint8)
    return found


def _passing(shared_filter, bits: int, ranges: int, which: int, names: list[str], placed: bool):
    """``names``: the columns that name a document. ``placed``: a column ``cuts`` has the places between digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed_bits = shared_filter.value
        for batch in batches:
            keys = [batch.column(batch.schema.get_field_index(n)) for n in names]
            cuts = batch.column(batch.schema.get_field_index("cuts")).to_pylist() if placed else None
            rows, chosen, spans, n = [], [], [], 0

            def sent() -> pa.RecordBatch:
                where = pa.array(np.repeat([r for r, _ in rows], [k for _, k in rows]).astype(np.int64))
                raw = np.concatenate(chosen)
                found = [k.take(where) for k in keys] + [pa.Array.from_buffers(pa.binary(16), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())]
                ends = [pa.array(np.concatenate([s[i] for s in spans]).astype(np.int64)) for i in (0, 1)] if placed else []
                return pa.RecordBatch.from_arrays([*found, *ends], names=[*names, "digest", *(["start", "end"] if placed else [])])

            for i, blob in enumerate(batch.column(batch.schema.get_field_index("digests")).to_pylist()):
                if not blob:
                    continue
                words = as_words(blob)
                passing = in_filter(packed_bits, bits, words)
                if ranges > 1:
                    passing &= range_of(words, ranges) == which
                at = np.flatnonzero(passing)
                if len(at):
                    rows.append((i, len(at)))
                    chosen.append(words[at])
                    if placed:
                        places = np.frombuffer(cuts[i], dtype="<i4")
                        spans.append((places[at], places[at + 1]))
                    n += len(at)
                if n >= SENT_ROWS:
                    yield sent()
                    rows, chosen, spans, n = [], [], [], 0
            if n:
                yield sent()

    return run


def suspects(digests: DataFrame, names: list[str], name: str, placed: bool = False, max_bits: int = MAX_BITS) -> DataFrame:
    """A stored row for each digest of a document that another may have too: ``names``, digest, and start and end if ``placed``.

    ``digests`` is a stored table: ``names``, digests, and cuts if ``placed``.
    """
    spark = digests.sparkSession
    total = digests.agg(F.sum(F.octet_length("digests"))).first()[0] or 0
    wanted = max(MIN_BITS, total // 16 * BITS_A_DIGEST)
    ranges = -(-wanted // max_bits)
    bits = min(max_bits, 1 << (-(-wanted // ranges) - 1).bit_length())
    kinds = dict(digests.dtypes)
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "digest binary", *(["start long", "end long"] if placed else [])])
    found = []
    for which in range(ranges):
        shared_filter = spark.sparkContext.broadcast(twice_filter(digests, bits, ranges, which))
        found.append(stored(digests.mapInArrow(_passing(shared_filter, bits, ranges, which, names, placed), schema), f"{name}-suspects"))
        shared_filter.unpersist()
    return reduce(DataFrame.union, found)
