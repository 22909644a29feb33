"""Substring deduplication by content-defined chunking with a gear rolling hash.

The gear hash of a place depends on the 32 bytes before it only. A place is a chunk boundary if its
hash is the least within REACH bytes on either side, so boundaries move with the content, stand more than
REACH bytes apart and follow it again at once after an insertion: a passage has the same chunks
in any document, but for its edges.

Chunks are named by 128-bit digests. A once-seen and a twice-seen filter (see twice_filter) leave only
digests that may repeat; these are counted exactly, and each repeated chunk gets a first occurrence: the
smallest document, and the smallest place in it. A document's consecutive chunks whose first occurrences are
consecutive too form a run. A run is then extended byte by byte, to both sides, as far as the document and
the first occurrence agree (at most EXTEND bytes a side), and counts as a repeated passage from
``min_bytes`` on. So a passage is found and cut whole, though its edges lie inside chunks that differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marginalia.llm.shared import packed, stored, unpacked, with_text_key
from marginalia.llm.twice_filter import MAX_BITS, suspects

REACH = 24
MIN_TEXT = 64
MIN_BYTES = 160
EXTEND = 256
STEP = 1 << 22
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
NEVER = np.uint32(0xFFFFFFFF)
KEY = ["__bare", "__id", "__text"]
FIRST = ["first_bare", "first_id", "first_text"]
SPAN_FIELDS = [("start", T.LongType(), pa.int64()), ("end", T.LongType(), pa.int64()), ("first_bare", T.BooleanType(), pa.bool_()), ("first_id", T.LongType(), pa.int64()), ("first_text", T.LongType(), pa.int64()), ("first_start", T.LongType(), pa.int64())]


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The sum of GEAR[byte] shifted left by its distance, over the 32 bytes up to each place; built by doubling."""
    h = GEAR[raw]
    for width in (1, 2, 4, 8, 16):
        if len(h) > width:
            h = h.copy()
            h[width:] += h[:-width] << np.uint32(width)
    return h


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: have - width], values[width - have :]) if have < width else values


def boundaries(text: bytes, reach: int = REACH) -> np.ndarray:
    """Both ends of the text and the places behind a hash that is the least within ``reach``, the first of equal ones."""
    found = [np.zeros(1, dtype=np.int64)]
    margin = np.full(reach, NEVER)
    for start in range(0, len(text), STEP):
        low, high = max(0, start - reach - 31), min(len(text), start + STEP + reach)
        h = gear_hashes(np.frombuffer(text, dtype=np.uint8, count=high - low, offset=low))
        h[:31] = NEVER  # these have seen fewer than 32 bytes
        least = least_of(np.concatenate([margin, h, margin]), reach)
        at = np.flatnonzero((h < least[: len(h)]) & (h <= least[reach + 1 :])) + low + 1
        found.append(at[(at > start) & (at <= start + STEP)])
    found.append(np.array([len(text)], dtype=np.int64))
    return np.unique(np.concatenate(found))


def chunks(text: bytes | None) -> tuple[np.ndarray, list[bytes]]:
    """The boundaries of a text and the digests of the chunks between them. Texts under MIN_TEXT bytes have none."""
    if not text or len(text) < MIN_TEXT:
        return np.empty(0, dtype=np.int64), []
    cuts = boundaries(text)
    digest = xxhash.xxh3_128_digest
    places = cuts.tolist()
    return cuts, [digest(text[a:b]) for a, b in zip(places, places[1:])]


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [chunks(t) for t in batch.column(3).cast(pa.binary()).to_pylist()]
        rows = pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([b"".join(d) or None for _, d in found], pa.binary()), pa.array([c.astype("<i4").tobytes() for c, _ in found], pa.binary())],
            names=[*KEY, "digests", "cuts"],
        )
        yield rows.filter(rows.column(3).is_valid())


def _runs(keyed: DataFrame, max_bits: int) -> DataFrame:
    """Runs of repeated chunks whose first occurrence is another document's: KEY, start, end, FIRST, first_start."""
    digests = stored(keyed.select(*KEY, "text").mapInArrow(_digest_rows, "__bare boolean, __id long, __text long, digests binary, cuts binary"), "chunk-digests")
    found = suspects(digests, KEY, "chunk", placed=True, max_bits=max_bits)
    who = F.struct(*KEY)
    heads = stored(
        found.groupBy("digest").agg(F.min(F.struct(*KEY, "start")).alias("first"), F.max(who).alias("last"))
        .where(F.struct(*[F.col(f"first.{k}") for k in KEY]) != F.col("last"))
        .select("digest", *[F.col(f"first.{k}").alias(f) for k, f in zip(KEY, FIRST)], F.col("first.start").alias("first_start")),
        "chunk-heads",
    )
    placed = found.join(heads, "digest").where(who != F.struct(*[F.col(f).alias(k) for f, k in zip(FIRST, KEY)])).withColumn("shift", F.col("start") - F.col("first_start"))
    same = Window.partitionBy(*KEY, *FIRST, "shift")
    order = same.orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum("new").over(order)
    return stored(
        placed.withColumn("new", F.when(F.coalesce(reach, F.lit(-1)) < F.col("start"), 1).otherwise(0)).withColumn("run", run)
        .groupBy(*KEY, *FIRST, "shift", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select(*KEY, "start", "end", *FIRST, (F.col("start") - F.col("shift")).alias("first_start"), (F.col("end") - F.col("shift")).alias("first_end")),
        "chunk-runs",
    )


def _with_contexts(keyed: DataFrame, runs: DataFrame) -> DataFrame:
    """Each document's runs in one row, with the bytes before and behind each at its first occurrence."""
    asked = runs.select(*[F.col(f).alias(k) for f, k in zip(FIRST, KEY)], "first_start", "first_end").distinct()
    raw = F.encode("text", "UTF-8")
    low = F.greatest(F.col("first_start") - EXTEND, F.lit(0))
    known = keyed.select(*KEY, "text").dropDuplicates(KEY).join(asked, KEY).select(
        *[F.col(k).alias(f) for k, f in zip(KEY, FIRST)], "first_start", "first_end",
        F.substring(raw, (low + 1).cast("int"), (F.col("first_start") - low).cast("int")).alias("before"),
        F.substring(raw, (F.col("first_end") + 1).cast("int"), F.lit(EXTEND)).alias("behind"),
    )
    return runs.join(known, [*FIRST, "first_start", "first_end"]).groupBy(*KEY).agg(F.collect_list(F.struct("start", "end", *FIRST, "first_start", "before", "behind")).alias("runs"))


def agreeing(a: bytes, b: bytes) -> int:
    """How many bytes the two have in common from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.flatnonzero(np.frombuffer(a, dtype=np.uint8, count=n) != np.frombuffer(b, dtype=np.uint8, count=n))[0])


def extended(text: bytes, runs: list[dict], min_bytes: int) -> list[dict]:
    """The passages: runs extended to both sides as far as they agree with their first occurrence, if long enough."""
    spans = []
    for r in runs:
        left = agreeing(text[max(0, r["start"] - EXTEND) : r["start"]][::-1], r["before"][::-1])
        right = agreeing(text[r["end"] : r["end"] + EXTEND], r["behind"])
        start, end = r["start"] - left, r["end"] + right
        if end - start >= min_bytes:
            spans.append({"start": start, "end": end, **{f: r[f] for f in FIRST}, "first_start": r["first_start"] - left})
    spans.sort(key=lambda s: (s["start"], s["end"]))
    return spans


def without(text: bytes, spans: list[dict]) -> bytes:
    """The text without the spans, which come sorted. Where an end falls inside a character, that character goes too."""
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : max(at, s["start"])])
        at = max(at, s["end"])
    return b"".join([*kept, text[at:]]).decode("utf-8", "ignore").encode()


def _cut(min_bytes: int):
    kind = pa.list_(pa.struct([(name, k) for name, _, k in SPAN_FIELDS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = []
            for i, runs in enumerate(batch.column(3).to_pylist()):
                spans = extended(texts[i], runs, min_bytes) if runs else []
                if spans:
                    texts[i] = without(texts[i], spans)
                found.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), batch.column(2), pa.array(found, kind)], names=["doc_id", "text", "payload", "spans"])

    return run


def _cut_rows(docs: DataFrame, min_bytes: int, max_bits: int, how: str) -> DataFrame:
    """doc_id, text after the cut, payload, and spans."""
    keyed = with_text_key(packed(docs, "doc_id", "text"))
    runs = _with_contexts(keyed, _runs(keyed, max_bits))
    spans = T.ArrayType(T.StructType([T.StructField(name, k) for name, k, _ in SPAN_FIELDS]))
    schema = T.StructType([*(keyed.schema[c] for c in ("doc_id", "text", "payload")), T.StructField("spans", spans)])
    return keyed.join(runs, KEY, how).select("doc_id", "text", "payload", "runs").mapInArrow(_cut(min_bytes), schema)


def drop_repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with the passages that another document holds first cut out; the first occurrence stays.

    The first occurrence of a chunk is in the document with the smallest id, documents without an id coming
    last. Passages repeated within one document only stay, and so do those under ``min_bytes`` bytes. Null,
    empty and very short texts stay as they are; texts of any length are chunked whole. Rows that repeat an
    id are one document if their texts are equal, and are cut alike. Other columns pass through, whatever
    their names. An empty table gives an empty table. ``max_bits``: see twice_filter.
    """
    return unpacked(_cut_rows(docs, min_bytes, max_bits, "left"), docs.columns, "doc_id", "text")


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, max_bits: int = MAX_BITS) -> DataFrame:
    """A row for each repeated passage, and one for its place in the first document: doc_id, first_doc_id, start, end
    (byte offsets in UTF-8), is_first, and of the document that loses it bytes_dropped and kept_sha256 (null if is_first).

    Rules and awkward rows: see drop_repeated_spans. An empty table gives no rows.
    """
    sized = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("size"))
    cut = stored(
        _cut_rows(sized, min_bytes, max_bits, "inner").where(F.size("spans") > 0)
        .select("doc_id", (F.col("payload.size") - F.octet_length("text")).alias("bytes_dropped"), F.sha2("text", 256).alias("kept_sha256"), "spans"),
        "chunk-cuts",
    )
    spans = cut.select("doc_id", "bytes_dropped", "kept_sha256", F.explode("spans").alias("s"))
    first_id = F.when(~F.col("s.first_bare"), F.col("s.first_id"))
    lost = spans.select("doc_id", first_id.alias("first_doc_id"), "s.start", "s.end", F.lit(False).alias("is_first"), "bytes_dropped", "kept_sha256")
    end = F.col("s.first_start") + F.col("s.end") - F.col("s.start")
    kept = spans.select(first_id.alias("doc_id"), "s.first_text", F.col("s.first_start").alias("start"), end.alias("end")).distinct()
    return lost.unionByName(kept.select("doc_id", F.col("doc_id").alias("first_doc_id"), "start", "end", F.lit(True).alias("is_first"), F.lit(None).cast("long").alias("bytes_dropped"), F.lit(None).cast("string").alias("kept_sha256")))
