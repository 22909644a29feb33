"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are sets of shingles of three consecutive words. Shingles are ordered by
rarity over all documents. A document that contains a window holds all of its shingles, so the
prefix that must be joined is the rarest shingle alone. Candidates are cut by position (the
window must begin inside the document) and by length (and end inside it), then the document's
words at that place are compared with the window's words one by one.

Whole texts are read once for the shingles and once for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import packed, stored, unpacked

#: Words are runs of digits, letters a-z and all characters beyond ASCII, once A-Z are lowered; this is what stands between them.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 3
#: A benchmark whose windows or shingles take more bytes than this is joined by shuffles instead of being broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows of the bitmap that thins the documents' shingles before such a shuffle: 64 bits each.
BITMAP_ROWS = 1 << 20


def with_words(df: DataFrame, lowered: Column, name: str = "words") -> DataFrame:
    """Add the words of a lowered text: split, without the empty strings at either end."""
    parts = df.withColumn("__parts", F.split(lowered, BETWEEN))
    head = (F.get("__parts", F.lit(0)) == "").cast("int")
    tail = (F.get("__parts", F.size("__parts") - 1) == "").cast("int")
    return parts.withColumn(name, F.slice("__parts", head + 1, F.greatest(F.size("__parts") - head - tail, F.lit(0)))).drop("__parts")


def exact(text: Column) -> Column:
    """A-Z lowered and no other letter changed."""
    return F.translate(text, UPPER, LOWER)


def rough(text: Column) -> Column:
    """All letters lowered, which is faster: the same number of words at the same places, and
    words equal in exact form are equal here too (both forms of sigma are one, since lowering
    picks one by what follows). For the candidate search only."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _shingles(words: str, size: int) -> Column:
    """The hash of the ``size`` words from each word on."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + k) for k in range(1, size)]))


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, window, len): window is the words joined by a space, in exact form."""
    named = benchmark.where(F.col("item_id").isNotNull()).select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    words = with_words(named, exact(F.col("text"))).select("item_id", "words").where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    return (
        words.select("item_id", "words", F.explode(starts).alias("s"))
        .select("item_id", F.slice("words", F.col("s") + 1, size).alias("w"))
        .select("item_id", F.array_join("w", " ").alias("window"), F.size("w").alias("len"))
        .distinct()
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and ``__id`` and ``__text`` (id and hash of the text), which name the row.

    A window is ``size`` consecutive words of an item, or all words of a shorter one. A
    document's word is hit if it lies in an occurrence of a window. Null and empty texts have no
    words; items without words or without an id have no windows; repeated items count once and
    repeated documents get equal rows. Texts of any length are read whole. Other columns of
    either table are not used. Empty tables give no rows, or rows without hits. ``broadcast_bytes``
    decides how the benchmark is joined, not the result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("__id"), F.xxhash64(text).alias("__text"), text.alias("text"))
    windows = stored(item_windows(benchmark, size), "benchmark-windows")
    n_bytes = windows.agg(F.sum(F.octet_length("window") + 100)).first()[0] or 0
    small = F.broadcast if n_bytes <= broadcast_bytes else (lambda df: df)
    distinct = windows.select("window", "len").distinct()
    widths = sorted(r.k for r in windows.select(F.least("len", F.lit(SHINGLE)).alias("k")).distinct().collect())
    parts = (
        distinct.select("window", "len", F.least("len", F.lit(SHINGLE)).alias("k"), F.split(rough(F.col("window")), " ").alias("words"))
        .select("window", "len", "k", "words", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))).alias("offset"))
        .select("window", "len", "k", "offset", F.xxhash64(*[F.when(F.lit(i) < F.col("k"), F.get("words", F.col("offset") + i)) for i in range(SHINGLE)]).alias("h"))
    )
    parts = stored(parts, "benchmark-shingles")
    few = parts.count() * 50 <= broadcast_bytes
    bucket, bit = F.pmod(F.col("h"), F.lit(BITMAP_ROWS)), F.shiftrightunsigned("h", 58)
    marks = parts.groupBy(bucket.alias("bucket")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).alias("marks"))

    # one pass over the texts: a row for each document (pos = n_words) and each benchmark shingle in it
    found = None
    wordy = with_words(rows, rough(F.col("text"))).drop("text")
    for k in [SHINGLE, *[w for w in widths if w != SHINGLE]]:
        hashes = _shingles("words", k)
        if k == SHINGLE:
            hashes = F.concat(hashes, F.array(F.xxhash64("__id", "__text")))
        places = wordy.select("doc_id", "__id", "__text", F.size("words").alias("n_words"), F.posexplode(hashes).alias("pos", "h"))
        known = parts.where(F.col("k") == k).select("h").distinct().withColumn("known", F.lit(True))
        if few:
            known = F.broadcast(known)
        else:
            # a bitmap of all the benchmark's shingles, of BITMAP_ROWS rows at most, keeps the other words from being shuffled
            thinned = places.withColumn("bucket", bucket).join(F.broadcast(marks), "bucket", "left")
            places = thinned.where((F.col("pos") == F.col("n_words")) | (F.call_function("shiftright", F.col("marks"), bit.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)).drop("bucket", "marks")
        hits = places.join(known, "h", "left").where((F.col("pos") == F.col("n_words")) | F.col("known") & (F.col("pos") + k <= F.col("n_words")))
        hits = hits.select("doc_id", "__id", "__text", "n_words", "pos", "h", F.lit(k).alias("k"))
        found = hits if found is None else found.union(hits)
    found = stored(found, "benchmark-places")
    places = found.where(F.col("pos") < F.col("n_words"))

    # the rarest shingle of each window; one that occurs nowhere rules the window out
    counts = places.groupBy("k", "h").agg(F.count("*").alias("df"))
    prefix = stored(
        parts.join(counts, ["k", "h"], "left")
        .groupBy("window", "len", "k").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "offset")).alias("p"))
        .where("p.df > 0").select("window", "len", "k", F.col("p.h").alias("h"), F.col("p.offset").alias("offset")),
        "benchmark-prefixes",
    )
    start = F.col("pos") - F.col("offset")
    candidates = (
        places.join(small(prefix), ["k", "h"]).where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
        .groupBy("__id", "__text").agg(F.collect_set(F.struct(start.alias("start"), "len", "window")).alias("cands"))
    )
    verified = (
        with_words(rows.select("__id", "__text", "text").join(candidates, ["__id", "__text"]), exact(F.col("text")))
        .dropDuplicates(["__id", "__text"])
        .select("__id", "__text", F.filter("cands", lambda c: F.array_join(F.slice(F.col("words"), c["start"] + 1, c["len"]), " ") == c["window"]).alias("hits"))
        .where(F.size("hits") > 0)
    )
    verified = stored(verified, "benchmark-hits")
    covered = F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1)))
    hit = verified.select("__id", "__text", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    items = (
        verified.select("__id", "__text", F.explode(F.array_distinct(F.transform("hits", lambda c: c["window"]))).alias("window"))
        .join(small(windows.select("window", "item_id")), "window")
        .groupBy("__id", "__text").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
        .select("__id", "__text", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    )
    report = stored(hit.join(items, ["__id", "__text"]), "benchmark-report")
    none = F.sha2(F.lit(""), 256)
    return (
        found.where((F.col("pos") == F.col("n_words")) & (F.col("k") == SHINGLE))
        .join(report, ["__id", "__text"], "left")
        .select(
            "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "__id", "__text",
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` without the documents that contain a window of an item.

    Documents without words stay; rows without an id are told apart by their texts; repeated rows stay or go together. Other columns
    pass through, whatever their names. An empty table gives an empty table, an empty benchmark all rows.
    """
    bad = contamination(docs, benchmark, size).where("contaminated").select("__id", "__text").distinct()
    keyed = packed(docs, "doc_id", "text").withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), "__text": F.xxhash64(F.coalesce("text", F.lit("")))})
    return unpacked(keyed.join(bad, ["__id", "__text"], "left_anti"), docs.columns, "doc_id", "text")
