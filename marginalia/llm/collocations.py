"""Phrase collocations: frequent word sequences whose parts are less frequent than they should be by chance.

N-grams become rows with counts, which are hash-aggregated by language: first all words, then the pairs of frequent words, then the
longer n-grams each two neighbouring words of which are a frequent pair. A phrase is at most as frequent as any part of it, so no
candidate and no part of one is missed, and the rare n-grams, of which nearly every position starts one, are not shuffled. The
frequent words and pairs travel to the tasks as bitmaps of bounded size, which may let rare ones pass but hold back no frequent one.

A task takes texts in portions, turns their words into numbers, finds n-grams by array operations and makes strings
of the distinct ones only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.shared import stored

MAX_N, MIN_COUNT, ABSORB_PERCENT, TOP = 5, 100, 100, 2000
#: In bytes of UTF-8, which only ASCII characters share with no other: A-Z lowered, a tab as a space, and a line end for every sign
#: that ends a piece.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
#: A bitmap has BITS_A_KEY bits for each of its keys, between these bounds (2^28 bits are 32 MB).
BITS_A_KEY, MIN_BITS, MAX_BITS = 16, 1 << 16, 1 << 28
#: Characters that a task counts together; a longer text makes a portion of its own.
PORTION_CHARS = 1 << 22
#: A language's candidates are ranked in so many parts first, each of which sends on its first ``top``.
RANK_PARTS = 32
COUNTED = "lang string, phrase string, n long"


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    head = lang.encode() + b"\n"
    return np.array([xxhash.xxh64_intdigest(head + w, 7) for w in words], dtype=np.uint64)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = first * np.uint64(0x9E3779B97F4A7C15) ^ (second >> np.uint64(29)) ^ (second << np.uint64(35))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def phrase_bitmap(phrases: DataFrame, n: int) -> np.ndarray:
    """A bitmap in which the bit of each of the ``n`` rows (lang, phrase), words or pairs, is set; at most MAX_BITS long.

    Tasks send the numbers of their 64-bit groups with the bits set; equal groups are merged before they reach the driver.
    """
    bits = MIN_BITS
    while bits < min(MAX_BITS, n * BITS_A_KEY):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pd.DataFrame({"lang": batch.column(0).to_pylist(), "phrase": batch.column(1).to_pylist()})
            for lang, own in rows.groupby("lang"):
                words = [p.encode().split(b" ") for p in own["phrase"]]
                h = word_hashes(lang, [w[0] for w in words])
                if len(words[0]) == 2:
                    h = pair_hashes(h, word_hashes(lang, [w[1] for w in words]))
                at = (h & np.uint64(bits - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(at & 63)], names=["word", "bit"])

    merged = phrases.select("lang", "phrase").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.expr("bit_or(shiftleft(1L, cast(bit as int)))").alias("mask"))
    table = np.zeros(bits // 64, dtype=np.int64)
    rows = merged.toArrow()
    table[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return table.view(np.uint8)


class Portion:
    """The words of some texts of one language as numbers, with line ends between pieces among them."""

    def __init__(self, lang: str, texts: list[str]):
        data = "\n".join(texts).encode().translate(PLAIN).replace(b"\n", b" \n ")
        words = pc.split_pattern(pa.array([data], pa.large_binary()), pattern=" ").values.dictionary_encode()
        self.lang, self.names = lang, words.dictionary
        listed = self.names.to_pylist()
        codes = words.indices.to_numpy().astype(np.int64)
        blank = next((i for i, w in enumerate(listed) if not w), -1)
        self.codes = codes[codes != blank]
        self.listed = listed
        self.is_word = np.array([w not in (b"", b"\n") for w in listed], dtype=bool)

    def words(self) -> tuple[pa.Array, np.ndarray]:
        n = np.bincount(self.codes, minlength=len(self.names))
        return self.names.filter(pa.array(self.is_word)), n[self.is_word]

    def _often(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of two neighbours both of which are words of the bitmap, and the words' hashes."""
        h = word_hashes(self.lang, self.listed)
        ok = self.is_word & in_bitmap(words, h)
        return np.flatnonzero(ok[self.codes[:-1]] & ok[self.codes[1:]]), h

    def _named(self, keys: np.ndarray, phrases: pa.Array) -> pa.Array:
        """The strings of n-grams whose number is that of a shorter one times the number of words, plus the last word."""
        head, last = np.divmod(keys, len(self.names))
        return pc.binary_join_element_wise(phrases.take(pa.array(head)), self.names.take(pa.array(last)), pa.scalar(b" ", pa.large_binary()))

    def pairs(self, words: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        at, _ = self._often(words)
        keys, n = np.unique(self.codes[at] * len(self.names) + self.codes[at + 1], return_counts=True)
        return self._named(keys, self.names), n

    def longer(self, words: np.ndarray, pairs: np.ndarray, max_n: int) -> tuple[pa.Array, np.ndarray]:
        at, h = self._often(words)
        at = at[in_bitmap(pairs, pair_hashes(h[self.codes[at]], h[self.codes[at + 1]]))]
        linked = np.zeros(len(self.codes) + max_n, dtype=bool)
        linked[at] = True
        at = at[linked[at + 1]]
        found, counts = [self.names.slice(0, 0)], [np.empty(0, dtype=np.int64)]
        keys, number = np.unique(self.codes[at] * len(self.names) + self.codes[at + 1], return_inverse=True)
        phrases = self._named(keys, self.names)
        for size in range(3, max_n + 1):
            go_on = linked[at + size - 2]
            at = at[go_on]
            keys, number, n = np.unique(number[go_on] * len(self.names) + self.codes[at + size - 1], return_inverse=True, return_counts=True)
            phrases = self._named(keys, phrases)
            found.append(phrases)
            counts.append(n)
        return pa.concat_arrays(found), np.concatenate(counts)


def _by_portion(count: Callable[[Portion], tuple[pa.Array, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        chars = 0

        def sent(lang: str, texts: list[str]) -> pa.RecordBatch:
            phrases, n = count(Portion(lang, texts))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrases.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(text)
                chars += len(text)
                if chars >= PORTION_CHARS:
                    yield from (sent(*x) for x in held.items())
                    held, chars = {}, 0
        yield from (sent(*x) for x in held.items())

    return run


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Frequencies of all phrases that are frequent, (lang, phrase, size, f), and the words of each language, (lang, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.length("text") > 0)

    def counts(count: Callable[[Portion], tuple[pa.Array, np.ndarray]]) -> DataFrame:
        return rows.mapInArrow(_by_portion(count), COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))

    def frequent(df: DataFrame, name: str) -> DataFrame:
        return stored(df.where(F.col("f") >= min_count).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"), name)

    every = stored(counts(Portion.words), "words")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    found = every.where(F.col("f") >= min_count).select("lang", "phrase", F.lit(1).alias("size"), "f")
    if max_n < 2:
        return found, totals
    words = spark.sparkContext.broadcast(phrase_bitmap(found, found.count()))
    pairs = frequent(counts(lambda p: p.pairs(words.value)), "pairs")
    found = found.unionByName(pairs)
    if max_n < 3:
        return found, totals
    linked = spark.sparkContext.broadcast(phrase_bitmap(pairs, pairs.count()))
    return found.unionByName(frequent(counts(lambda p: p.longer(words.value, linked.value, max_n)), "longer-phrases")), totals


def _part(start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("w", start, length), " ")


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, absorb_percent: int = ABSORB_PERCENT, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``; a null
    language is ``und`` and a null text empty. A phrase of 2 to ``max_n`` words that occurs ``min_count`` times or more is scored
    floor(1000 * a * n / (l * r)) at its lowest-scoring cut, ties to the earliest, in Decimal (38 digits, which last up
    to some 10^17 words). A phrase goes if a longer candidate holds it that has ``absorb_percent`` of its occurrences; as a
    phrase is at most as frequent as its parts, looking one word further is enough. Ties in rank go to the more frequent,
    then to the lesser phrase in UTF-8 order. Repeated rows count each time, ids aren't used, other columns are ignored. An
    empty table, or one without frequent phrases, gives an empty table.
    """
    counted, totals = phrase_counts(docs, max_n, min_count)
    words = F.split("phrase", " ")
    candidates = counted.where("size > 1").withColumn("w", words)
    # what a phrase of one word more keeps of its first and last part
    longer = candidates.where("size > 2").select("lang", "f", F.explode(F.array(_part(F.lit(1), F.col("size") - 1), _part(F.lit(2), F.col("size") - 1))).alias("phrase"))
    held = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    own = candidates.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorb_percent * F.col("f")))
    cuts = own.select("lang", "phrase", F.col("f").alias("a"), "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("__first"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("__rest"))
    parts = counted.select("lang", F.col("phrase").alias("__part"), "f")
    cuts = cuts.join(parts.select("lang", F.col("__part").alias("__first"), F.col("f").alias("l")), ["lang", "__first"])
    cuts = cuts.join(parts.select("lang", F.col("__part").alias("__rest"), F.col("f").alias("r")), ["lang", "__rest"]).join(totals, "lang")
    score = F.expr("cast(cast(cast(a as decimal(18,0)) * cast(n as decimal(18,0)) as decimal(35,0)) * cast(1000 as decimal(4,0)) as decimal(38,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best"))
    flat = scored.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))], ["lang"]):
        flat = flat.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return flat.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
