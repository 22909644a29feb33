"""Periodic runs, collocations and personal data against plain versions, and on the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import collocations, periodic_runs, pii, queries
from tests.llm.test_llm import DATA, DOC, clashing, empty, frame, plain, prose

# --- periodic runs


def plain_runs(seq, min_words=24, min_exponent=3):
    found = {}
    for q in range(1, len(seq) // min_exponent + 1):
        i = 0
        while i + q < len(seq):
            if seq[i] != seq[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(seq) and seq[i] == seq[i + q]:
                i += 1
            if i + q - s >= max(min_words, min_exponent * q):
                found.setdefault((s, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


PIECES = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=4), st.sampled_from([(24, 3), (6, 2), (10, 3), (1, 2), (30, 5)]), st.sampled_from([3, 1 << 20]))
def test_find_runs(texts, bounds, leaves):
    seqs = [[x for part, n in t for x in part * n] for t in texts]
    before, periodic_runs.LEAVES = periodic_runs.LEAVES, leaves
    try:
        got = periodic_runs.find_runs(np.array([x for s in seqs for x in s], dtype=np.int64), np.array([len(s) for s in seqs], dtype=np.int64), *bounds)
    finally:
        periodic_runs.LEAVES = before
    assert got == [plain_runs(s, *bounds) for s in seqs]


def plain_op11(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_on_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_periodic_runs(spark, f"{DATA}/sf0.001").select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    want = [plain_op11(*d) for d in docs]
    assert sum(w[1] for w in want) > 10 and plain(got) == sorted(want, key=repr)


def test_periodic_runs_awkward(spark, tmp_path):
    r = random.Random(4)
    docs = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 24), (4, "a " * 24), (5, "a " * 23), (None, "x y z " * 12), (6, "Na na " * 13), (7, prose(40_000, 9)), (8, " ".join(["deep"] * 30_000)), (20, prose(90, 3) + " " + (prose(7, 4) + " ") * 9), (35, (prose(30, 5) + " ") * 2)]
    df = clashing(frame(spark, docs))
    got = periodic_runs.periodic_runs(df)
    assert set(df.columns) - {"runs"} <= set(got.columns)
    rows = {(x.doc_id, x.text): x for x in got.collect()}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want = plain_runs(w) if len(w) < 20_000 else [] if i == 7 else [(0, 30_000, 1)]
        assert [tuple(x) for x in rows[i, t].runs] == want
    assert rows[8, docs[9][1]].collapsed == "deep" and rows[1, None].collapsed == "" and got.count() == len(docs)
    assert periodic_runs.periodic_runs(empty(spark)).count() == 0
    r.shuffle(docs)
    spark.createDataFrame([(i, t, "en", "s", None, "x", "y", "z") for i, t in docs if i not in (7, 8)], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_op11(i, t) for i, t in docs if i not in (7, 8)), key=repr)


# --- collocations


def plain_collocations(rows, max_n=5, low=100, absorb=100, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f[lang, w[i : i + k]] += 1
    held = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= low}
    out = []
    for (lang, w), a in held.items():
        inside = lambda v, w=w: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
        if any(la == lang and len(v) > len(w) and 100 * b >= absorb * a and inside(v) for (la, v), b in held.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, score, a, " ".join(w), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    ranked = []
    for lang in sorted(n):
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))
        ranked += [(lang, i + 1, p, a, left, r, m, s) for i, (_, s, a, p, left, r, m) in enumerate(own[:top])]
    return ranked


def language_rows(seed):
    r = random.Random(seed)
    out = []
    for i in range(120):
        words = [r.choice(["a", "b", "The", "the", "ß", "Σ", "new york", "new york city hall", "on the other hand", "x"]) for _ in range(r.randint(0, 60))]
        out.append((i, "".join(w + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!"]) for w in words), r.choice(["en", "en", "de", None, "und"])))
    return [*out, (None, None, "en"), (5, "", None), (5, "a b a b", "de"), (5, "a b a b", "de"), (7, "long " * 20_000, "fr")]


@pytest.mark.parametrize(("max_n", "low", "absorb", "top"), [(5, 5, 100, 2000), (5, 3, 60, 7), (2, 4, 100, 50), (3, 2, 1, 100), (5, 10**9, 100, 10)])
def test_collocations(spark, max_n, low, absorb, top):
    rows = language_rows(6)
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, lang string, phrase string").repartition(3)
    got = collocations.collocations(df, max_n, low, absorb, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_collocations([(lang, t) for _, t, lang in rows], max_n, low, absorb, top))
    assert collocations.collocations(df.limit(0)).count() == 0


def test_collocations_with_a_full_bitmap_and_small_counters(spark, monkeypatch):
    """What the bitmap lets pass, and how often a task sends on, changes no count; scores may pass 64 bits."""
    rows = language_rows(8)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    want = sorted(plain_collocations([(lang, t) for _, t, lang in rows], low=4))
    monkeypatch.setattr(collocations, "MIN_BITS", 64)
    monkeypatch.setattr(collocations, "MAX_BITS", 64)
    monkeypatch.setattr(collocations, "PORTION_CHARS", 300)
    assert sorted(map(tuple, collocations.collocations(df, min_count=4).collect())) == want


def test_op12_matches_sql(spark, duck, same):
    same(queries.op12_collocations(spark, f"{DATA}/sf0.01"), duck("sf0.01"), queries.COLLOCATIONS_SQL)


# --- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    v = [int(d) for d in reversed(digits)]
    return sum(v[::2] + [sum(divmod(2 * x, 10)) for x in v[1::2]]) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@@..+-%_ 0123459() \n٣é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1", "001.2.3.0004", "1.2.3.4.5.6.7.8", "+1 (555) 123-4567", "+1", "++49.30.1234567", "a@b.c", "a@b", "a@b@c.de", "x.@-.-", "é@a.b", ".", " ", "@", "0" * 20]), max_size=12), st.sampled_from(["", " "]))
def test_base_spans_of_whole_forms(parts, between):
    text = between.join(parts)
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_texts_are_found_in_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000 + "x", "a@" * 100_000, "+1 " * 100_000, "+1" + "(" * 200_000):
        assert len(pii.base_spans(text)) <= len(text) // 8


def every_path(e, t):
    """The best path by trying all of them."""
    from itertools import product

    best = max(product(range(e.shape[1]), repeat=len(e)), key=lambda y: t.first[y[0]] + t.last[y[-1]] + sum(e[i, v] for i, v in enumerate(y)) + sum(t.trans[a, b] for a, b in zip(y, y[1:])))
    return list(best)


def test_decoding_is_exact():
    """The cuts at certain words change nothing: against a Viterbi over the whole text, and that against all paths."""
    tagger = pii.default_tagger()
    decoder = pii.Decoder(tagger)
    r = random.Random(3)
    texts = [pii.WORD.findall(x) for x, _ in pii.examples(1, 77)]
    texts += [[w for t in r.sample(texts, 4) for w in t], [], ["+1"], texts[0] * 300]

    def scores(words):
        own = [tagger.rows(tuple(pii.own_features(w, tagger.cues))) for w in words]
        return np.array([own[i][1] + (own[i - 1][0] if i else 0) + (own[i + 1][2] if i + 1 < len(own) else 0) for i in range(len(own))])

    want = []
    for i, words in enumerate(texts):
        if words:
            best = pii._viterbi(scores(words)[None], np.array([len(words)]), tagger.first[None], tagger.last[None], tagger.trans)[0]
            want += [(i, k, int(v)) for k, v in enumerate(best) if v]
    assert decoder.labels(texts) == want
    short = scores(texts[0][:5])
    assert every_path(short, tagger) == pii._viterbi(short[None], np.array([5]), tagger.first[None], tagger.last[None], tagger.trans)[0].tolist()


def test_tagger_on_unseen_examples():
    decoder, right, wrong, missed = pii.Decoder(pii.default_tagger()), 0, 0, 0
    for text, want in pii.examples(10, 4321):
        labels = [(w, label) for _, w, label in decoder.labels([pii.WORD.findall(text)])]
        got = pii.found_spans(text, labels, pii.base_spans(text))
        right += len(set(got) & set(want))
        wrong += len(set(got) - set(want) - set(pii.base_spans(text)))
        missed += len(set(want) - set(got))
    assert right > 20 * wrong and right > 20 * missed


def test_personal_data(spark):
    docs = [
        (1, None), (2, ""), (3, "mail jane.d@example.org, or 10.0.0.1!"), (3, "mail jane.d@example.org, or 10.0.0.1!"), (None, "call me at (212) 555-0199 now"), (4, "ö\U0001f600 x@y.zz +49 (30) 1234-5678"), (5, prose(50_000, 2) + " 4111 1111 1111 1111"),
        (6, "write to jane at example dot com today"), (7, prose(200, 8)),
    ]
    df = clashing(frame(spark, docs)).withColumn("base_spans", F.lit("clash"))
    got = pii.personal_data(df).select("doc_id", "text", "base_spans", "spans").collect()
    assert len(got) == len(docs) and pii.personal_data(empty(spark)).count() == 0
    for x in got:
        base = [tuple(s) for s in x.base_spans]
        assert base == plain_spans(x.text) and set(base) <= {tuple(s) for s in x.spans}
        assert [tuple(s) for s in x.spans] == sorted(map(tuple, x.spans), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
    said = {x.doc_id: [(s.kind, x.text[s.start : s.end]) for s in x.spans] for x in got}
    assert said[None] == [("phone", "(212) 555-0199")] and said[6] == [("email", "jane at example dot com")] and said[7] == [] and said[2] == []


def test_op13_on_the_table(spark):
    got = queries.op13_pii(spark, f"{DATA}/sf0.001").collect()
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for x in got:
        base = plain_spans(texts[x.doc_id])
        listed = [":".join(map(str, s)) for s in base]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert x.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(x.spans.split(",") if x.spans else [])


def test_a_table_without_examples_finds_nothing():
    decoder = pii.Decoder(pii.fit([]))
    assert decoder.labels([["+1", "a"], []]) == decoder.labels([]) == decoder.labels([[]]) == []
