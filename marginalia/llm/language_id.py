"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of sample texts. A text, reduced to its
letters, is compressed with each of them, in pieces so that the dictionary matters throughout a long text; the language
whose dictionary gives the smallest size wins. Where the two smallest sizes are too close the
prediction is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.shared import stored

#: The fit uses at most about SAMPLE_DOCS whole texts a language, and of their letters the last DICT_BYTES, which is
#: what zstandard prefers. A language with less than MIN_DICT_BYTES of them isn't learned.
SAMPLE_DOCS, DICT_BYTES, MIN_DICT_BYTES = 200, 1 << 16, 1 << 11
#: Counts of more labels than this are joined by a shuffle instead of being broadcast.
MAX_BROADCAST_LANGUAGES = 100_000
LEVEL = 9
PIECE_BYTES = 1 << 13
MIN_MARGIN = 0.01
#: Word characters but digits; among them numbers that are no decimal digits (½, ², Ⅷ), which are no letters.
LETTER = re.compile(r"[^\W\d_]")
NO_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def bare(text: str) -> bytes:
    """The letters of a whole text: lowered, what stands between words one space, a word that is
    repeated at once written once. Ornaments, case and repetition say nothing of the language."""
    plain = NO_LETTERS.sub(" ", text.lower())
    if not plain.replace(" ", "").isalpha():
        plain = "".join(c if c.isalpha() else " " for c in plain)
    return " ".join(word for word, _ in groupby(plain.split())).encode("utf-8", "replace")


def _letters(dict_bytes: int):
    """Rows (lang, n, k, text) to (lang, n, k, letters): of each text the last ``dict_bytes`` of its letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [bare(t)[-dict_bytes:] for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cut, pa.binary())], names=["lang", "n", "k", "letters"])

    return run


def _joined(dict_bytes: int):
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        """One language's dictionary, of its sampled texts in the order of their hash."""
        rows = sample.sort_values(["k", "letters"])
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "n": [int(rows["n"].iloc[0])], "known": [b"\n".join(rows["letters"])[-dict_bytes:]]})

    return run


def learn_dictionaries(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, min_bytes: int = MIN_DICT_BYTES, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Language to dictionary, from rows of (doc_id, text, lang) chosen by a hash of the id; the commonest language first.

    Rows without an id, a language or a letter of text take no part; repeated rows count each time. A text is cut to the last
    ``dict_bytes`` of its letters before it is shuffled, as no dictionary holds more; a task for each language joins about ``sample_docs``
    of them, and the driver gets at most ``dict_bytes`` a language. Languages with less than ``min_bytes`` of letters are left out: their
    texts are taken for another language. No usable rows give no dictionaries.
    """
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    counts = stored(train.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    small = F.broadcast if counts.count() <= MAX_BROADCAST_LANGUAGES else (lambda df: df)
    share = F.col("n") * F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1_000_000))
    sample = train.join(small(counts), "lang").where(share < F.lit(sample_docs * 1_000_000)).select("lang", "n", F.xxhash64(F.col("doc_id").cast("string")).alias("k"), "text")
    letters = sample.mapInArrow(_letters(dict_bytes), "lang string, n long, k long, letters binary")
    known = letters.groupBy("lang").applyInPandas(_joined(dict_bytes), "lang string, n long, known binary")
    return {r.lang: bytes(r.known) for r in sorted(known.where(F.octet_length("known") >= min_bytes).collect(), key=lambda r: (-r.n, r.lang))}


class Judge:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = list(dictionaries)
        self.coders = []
        for data in dictionaries.values():
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        pieces = [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow. No letter: ``und``, 0, rejected."""
        if not self.langs or text is None or not has_letter(text):
            return "und", 0.0, True
        sizes = self.sizes(bare(text))
        best, *others = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if not others:
            return self.langs[best], 1.0, False
        margin = (sizes[others[0]] - sizes[best]) / sizes[others[0]]
        return self.langs[best], margin / (margin + 0.02), margin < MIN_MARGIN


def _judge_rows(dictionaries: dict[str, bytes], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries)
        for batch in batches:
            found = [judge.predict(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            made = {
                "lang_pred": pa.array([f[0] for f in found], pa.string()),
                "score": pa.array([f[1] for f in found], pa.float64()),
                "rejected": pa.array([f[2] for f in found], pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)

    return run


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Every row of ``docs`` with ``lang_pred``, ``score`` (0 to 1, from the margin between the
    two smallest sizes) and ``rejected``.

    Input columns of those names are replaced, others pass through. Null texts and texts without
    a letter, the empty one included, are ``und`` with score 0. Texts of any length are
    compressed whole. Equal sizes go to the language that comes first, which is the commoner one. Without dictionaries
    every row is ``und``. An empty table gives an empty table.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.mapInArrow(_judge_rows(dictionaries, schema.names), schema)
