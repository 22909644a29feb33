"""Line deduplication with a once-seen and a twice-seen Bloom filter.

1. Every document's lines are hashed once; its distinct keys are kept as a row of 16-byte digests.
2. Two Bloom filters over the digests (see twice_filter) leave the suspected repeats: only these are
   shuffled and counted exactly.
3. A key found in ``min_docs`` documents keeps its lines in the document with the largest id
   and loses them elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.shared import packed, stored, unpacked, with_row_key
from marginalia.llm.twice_filter import MAX_BITS, suspects

WHITE = b" \t\n\x0b\x0c\r"
KEY = ["__id", "__salt"]


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lowered, everything else as it is."""
    return line.strip(WHITE).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    """Whether a key has at least ``min_chars`` code points."""
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def document_digests(text: bytes | None, min_chars: int) -> set[bytes]:
    """The 128-bit digests of a document's eligible line keys, each once."""
    if not text:
        return set()
    digest = xxhash.xxh3_128_digest
    return {digest(k) for k in map(line_key, text.split(b"\n")) if long_enough(k, min_chars)}


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def _digest_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b"".join(document_digests(t, min_chars)) or None for t in _texts(batch, "text")]
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=[*KEY, "digests"])
            yield rows.filter(rows.column(2).is_valid())

    return run


def _rewrite(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            texts = _texts(batch, "text")
            lines, dropped = [], []
            for i, (text, drop) in enumerate(zip(texts, batch.column(batch.schema.get_field_index("drops")).to_pylist(), strict=True)):
                if not text or not drop:
                    lines.append((text or b"").count(b"\n") + 1)
                    dropped.append(0)
                    continue
                gone = set(drop)
                parts = text.split(b"\n")
                kept = [p for p in parts if not (long_enough(k := line_key(p), min_chars) and digest(k) in gone)]
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
                texts[i] = b"\n".join(kept)
            made = {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            names = ["doc_id", "text", "payload", "n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """Drop lines that many documents share, except in the document with the largest id.

    Returns every row of ``docs`` with ``text`` rewritten, and ``n_lines`` (before) and
    ``n_dropped``. Columns of those names in the input are replaced; others pass through, whatever their names.

    Null and empty texts have one empty line and stay as they are. Rows count as documents,
    so a repeated row counts each time; rows that share the largest id all keep the line.
    Rows without an id rank below every id; a line that only such rows hold stays.
    Lines of any length are hashed whole. An empty table gives an empty table. ``max_bits`` bounds
    a filter; more lines take more passes over their digests, with the same result.
    """
    docs = docs.drop("n_lines", "n_dropped")
    keyed = with_row_key(packed(docs, "doc_id", "text"))
    digests = stored(keyed.select(*KEY, "text").mapInArrow(_digest_rows(min_chars), "__id long, __salt long, digests binary"), "line-digests")
    found = suspects(digests, KEY, "line", max_bits=max_bits)
    heads = stored(
        found.groupBy("digest")
        .agg(F.count("*").alias("n"), F.max(F.when(F.col("__salt") == 0, F.col("__id"))).alias("keep"))
        .where((F.col("n") >= min_docs) & F.col("keep").isNotNull())
        .select("digest", "keep"),
        "line-heads",
    )
    drops = (
        found.join(heads, "digest")
        .where((F.col("__salt") != 0) | (F.col("__id") != F.col("keep")))
        .groupBy(*KEY)
        .agg(F.collect_set("digest").alias("drops"))
    )
    schema = T.StructType([keyed.schema[c] for c in ("doc_id", "text", "payload")] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out = keyed.join(drops, KEY, "left").select("doc_id", "text", "payload", "drops").mapInArrow(_rewrite(min_chars), schema)
    return unpacked(out, [*docs.columns, "n_lines", "n_dropped"], "doc_id", "text", "n_lines", "n_dropped")
