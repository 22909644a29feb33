"""Toxicity scores from a weighted lexicon matched with Aho-Corasick.

Text is folded first: case, accents, full-width forms, homoglyphs of other scripts and digits
that stand for letters. The lexicon holds word beginnings and whole words with weights learned
from labelled rows (log ratio of their document frequencies in toxic and other documents).
Exception phrases are two words, one of them a hit, that are no
commoner in toxic rows than in others; they are learned too. Hits inside one do not count. A logistic curve over the summed weights, as they
are and normalised by length, turns them into a score.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.shared import crc_share, held_out

#: Letters of other scripts that look like Latin ones, and digits or signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
OUTER_SIGN = re.compile(r"[$@]+(?![^\W_])")
INVISIBLE = "­​‌‍⁠﻿"

MAX_SAMPLE = 20_000
PREFIX_CHARS = (3, 10)
MIN_DOCS = 5
MIN_WEIGHT = 1.6


def fold_table() -> dict[int, str]:
    """Code point to folded text, for str.translate: letters, or a space for anything else.

    Latin letters lose case and accents; l and i fall together, since 1 may stand for either.
    """
    found: dict[int, str] = {}
    for point in [*range(0x00, 0x250), *range(0x300, 0x460), *range(0x4C0, 0x530), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        char = unicodedata.normalize("NFKC", chr(point)).lower()[:1] or " "
        base = unicodedata.normalize("NFKD", char)[0]
        base = HOMOGLYPHS.get(char, HOMOGLYPHS.get(base, base))
        base = DIGITS.get(base, base)
        found[point] = base.replace("l", "i") if base.isalpha() else ("" if unicodedata.combining(chr(point)) else " ")
    found.update({ord(c): "" for c in INVISIBLE})
    for point in range(0x2000, 0x2070):
        found.setdefault(point, " ")
    return found


FOLD = fold_table()


def fold(text: str) -> str:
    """Signs stand for letters only inside a word or before one: ``$cum``, but not ``scum$$$``."""
    if "$" in text or "@" in text:
        text = OUTER_SIGN.sub(" ", text)
    return text.translate(FOLD)


def features(token: str) -> list[str]:
    """What a folded token may match: its beginnings, and itself as a whole word."""
    low, high = PREFIX_CHARS
    return [" " + token[:n] for n in range(low, min(high, len(token)) + 1)] + [f" {token} "]


@dataclass
class Lexicon:
    """weights: pattern (a space, then a word beginning, or a whole word between spaces) to weight."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (-2.0, 0.0, 0.0, 0.0)
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_machine": None}

    def machine(self):
        if self._machine is None:
            found = ahocorasick.Automaton()
            for pattern, weight in self.weights.items():
                found.add_word(pattern, (len(pattern), weight))
            for phrase in self.exceptions:
                found.add_word(f" {fold(phrase)} ", (len(phrase) + 2, None))
            if len(found):
                found.make_automaton()
            self._machine = found
        return self._machine

    def measure(self, text: str | None) -> tuple[float, float, float]:
        """Summed weights (logarithm), summed weights for each word, and the heaviest weight.

        Of several patterns that begin at one word the heaviest counts.
        """
        if not text or not self.weights:
            return 0.0, 0.0, 0.0
        folded = " " + " ".join(fold(text).split()) + " "
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.machine().iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if spared:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
        if not best:
            return 0.0, 0.0, 0.0
        total = sum(best.values())
        return float(np.log1p(total)), 20.0 * total / (20.0 + folded.count(" ") - 1), max(best.values())

    def phrases(self, text: str | None) -> set[str]:
        """The folded pairs of neighbouring words of which one begins with a hit."""
        tokens = fold(text or "").split()
        hits = {i for i, token in enumerate(tokens) if any(f in self.weights for f in features(token))}
        return {f"{tokens[i]} {tokens[i + 1]}" for h in hits for i in (h - 1, h) if 0 <= i < len(tokens) - 1}

    def score(self, text: str | None) -> float:
        bias, *slopes = self.curve
        x = bias + sum(a * b for a, b in zip(slopes, self.measure(text), strict=True))
        return float(1.0 / (1.0 + np.exp(-np.clip(x, -30, 30))))


def _counts(batches: Iterator[pa.RecordBatch], found) -> Iterator[pa.RecordBatch]:
    """Document frequencies by label, summed within the task before they are shuffled."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[toxic].update(found(text))
    names = list({*counts[0], *counts[1]})
    for start in range(0, len(names), 50_000):
        part = names[start : start + 50_000]
        yield pa.RecordBatch.from_pydict({"feature": pa.array(part, pa.string()), "toxic": pa.array([counts[1][f] for f in part], pa.int64()), "other": pa.array([counts[0][f] for f in part], pa.int64())})


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _counts(batches, lambda text: {f for token in set(fold(text or "").split()) for f in features(token)})


def _count_phrases(lexicon: Lexicon):
    return lambda batches: _counts(batches, lexicon.phrases)


def _measure_rows(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = (c.to_pylist() for c in batch.columns)
            found = np.array([lexicon.measure(t) for t in texts]).reshape(-1, 3)
            yield pa.RecordBatch.from_pydict({"toxic": pa.array(labels, pa.int32())} | {f"x{i}": pa.array(found[:, i]) for i in range(3)})

    return run


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge."""
    rows = np.c_[np.ones(len(x)), x]
    w = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (p - y) + ridge * w
        hess = (rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return tuple(map(float, w))


def prune(counted: dict[str, tuple[float, int]]) -> dict[str, float]:
    """The patterns worth keeping, of pattern to (weight, toxic documents).

    A beginning goes if one longer pattern has nine tenths of its toxic documents: that is the
    word itself, and the beginning would only add strangers. A pattern goes if a beginning that
    stays is nearly as heavy: that is a stem with many endings, and finds it too.
    """
    stem = lambda p: p.rstrip(" ")
    heaviest: dict[str, int] = {}
    for pattern, (_, n) in counted.items():
        above = stem(pattern) if pattern.endswith(" ") else pattern[:-1]
        heaviest[above] = max(heaviest.get(above, 0), n)
    able = {p: w for p, (w, n) in counted.items() if heaviest.get(p, 0) < 0.9 * n}
    kept: dict[str, float] = {}
    for pattern in sorted(able, key=len):
        whole = stem(pattern)
        above = max((kept[whole[:n]] for n in range(2, len(whole) + (pattern != whole)) if whole[:n] in kept), default=-np.inf)
        if able[pattern] > above + 0.35:
            kept[pattern] = able[pattern]
    return kept


def learn(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> Lexicon:
    """Fit lexicon and curve on labelled rows outside the held-out fold.

    At most about ``max_sample`` labelled rows are used, chosen by a hash of the id. One half of
    them gives the lexicon, the other the curve, so the curve isn't fitted to weights that know
    its rows. Null texts count as empty, repeated labels as toxic if one of them is. Without labelled rows of both kinds the lexicon is empty and every score 0.12.
    """
    train = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    n = train.count()
    train = train.where(crc_share("doc_id", min(1.0, max_sample / max(1, n))))
    rows = docs.select("doc_id", "text").join(train, "doc_id").select("text", "toxic", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("first"))
    n0, n1 = (int(train.where((F.col("toxic") == k) & (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)).count()) for k in (0, 1))
    if not n0 or not n1:
        return Lexicon({})
    t, c = F.col("toxic"), F.col("other")
    weight = F.log((t + 0.5) / (n1 + 1.0) / ((c + 0.5) / (n0 + 1.0)))
    counted = (
        rows.where("first").select("text", "toxic").mapInArrow(_count_features, "feature string, toxic long, other long")
        .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where(t >= MIN_DOCS).withColumn("weight", weight).where(F.col("weight") >= MIN_WEIGHT)
    )
    # the sample bounds the lexicon: each pattern is in MIN_DOCS of its toxic rows
    lexicon = Lexicon(prune({r.feature: (r.weight, r.toxic) for r in counted.collect()}))
    spared = (
        rows.where("first").select("text", "toxic").mapInArrow(_count_phrases(lexicon), "feature string, toxic long, other long")
        .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where(c >= MIN_DOCS).withColumn("weight", weight).where("weight <= 0")
    )
    lexicon = Lexicon(lexicon.weights, tuple(sorted(r.feature for r in spared.select("feature").collect())))
    measured = rows.where("NOT first").select("text", "toxic").mapInArrow(_measure_rows(lexicon), "toxic int, x0 double, x1 double, x2 double").toPandas()
    if measured["toxic"].nunique() == 2:
        lexicon.curve = fit_curve(measured[["x0", "x1", "x2"]].to_numpy(), measured["toxic"].to_numpy())
    return lexicon


def _score_rows(lexicon: Lexicon, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [lexicon.score(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            made = {"score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Input columns of those names are replaced, others pass through. Null, empty and very long
    texts are scored alike, over their whole length; a null or empty text gets the score of a
    text without hits. Repeated rows get equal scores. An empty table gives an empty table.
    """
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(_score_rows(lexicon, schema.names), schema)
