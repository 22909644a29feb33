"""Personal data: exact forms by pattern, and looser ones by a linear-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers that can be told by their form alone. The random field adds
what is told by its shape and neighbours: numbers after "call", addresses with "at" and "dot" spelled out and the like. Its
labels are O, B-kind and I-kind; a word's features are its shape, its cues (a few words known from the table of examples) and
those of its two neighbours. It is trained from ``examples()``, a small labelled table, by gradient steps on the exact
likelihood (forward-backward over all examples at once), and decoded by Viterbi in numpy batches.

Decoding is exact and covers whole texts: a run of other labels stands on a best path only if what its words gain over O together
makes up for their transitions, so all words outside of such runs are O for certain, chains are cut there, and only the
stretches between are decoded.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{edge}-{kind}" for kind in KINDS for edge in "BI"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGIT = re.compile(r"[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Signs spelled out in brackets.
SPELLED = re.compile(r"[\[(](?:at|dot|\.)[\])]", re.IGNORECASE)
#: Words whose scores are held together while texts are decoded, and distinct words remembered by a task.
PASS_WORDS, MEMORY = 200_000, 500_000
#: The fit takes at most so many examples.
MAX_EXAMPLES = 4000
STEPS, RATE, PENALTY = 120, 0.1, 0.02
SEED = 7

Span = tuple[str, int, int]


# --- exact forms -------------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def _emails(text: str) -> Iterator[Span]:
    """Leftmost addresses: the run of local characters before an @ and the domain behind it. Looked for from each @, so that
    a long run of letters is read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and LOCAL_BACK.match(text[begin - 1]):
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            free = domain.end()
            yield "email", begin, free
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))


def base_spans(text: str | None) -> list[Span]:
    """Spans (kind, start, end) of the exact forms, by kind and start, in code points."""
    if not text:
        return []
    out = list(_emails(text))
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# --- the table of examples ---------------------------------------------------------------------------------------------

#: Sentences with {kind:form} where personal data stands; a form's letters are filled in: 9 a digit, 8 a digit from 1 to 9,
#: a a word, h a host, L a card number that passes Luhn, N one that doesn't, d an address part. Lines without braces of a
#: kind are plain.
TEMPLATES = """
call me at {phone:(899) 899-9999} after a
phone: {phone:899-899-9999} a a
a tel {phone:899.899.9999} a, a
tel. {phone:0899 999999} a a
Telefon {phone:089 8999999} a a
tél : {phone:08 99 99 99 99} a
teléfono {phone:899 999 999} a a
mobile {phone:0899 999 9999} a a
fax {phone:(89) 8999-9999} a
please ring {phone:1-899-899-9999} a a
reach us on {phone:899 899 9999} a
a a {phone:+8 (899) 899-9999} a a
a {phone:+89 899 999999} a
a | {phone:+8 (899) 899-9999} | a
write to {email:a at h dot com} a
mail {email:a.a at h dot org} a a
contact {email:h [at] h [dot] com} a
e-mail {email:h (at) h (dot) net} a
email: {email:a AT h DOT com} a
a {email:h[at]h[dot]com} a a
a {email:h(at)h.com} a
schreib an {email:a at h dot de} a
écris à {email:a at h dot fr} a a
a a {email:h at h dot com} a a
a, {email:h dot h at h dot com}. a a
escribe a {email:a arroba h punto com} a
a a {email:h.99@h8.example.com} a a
{email:h.h@h.com} a a
server {ip:d.d.d.d} a a
host {ip:d.d.d.d}:8999 a
a a {ip:d.d.d.d} a a
ip address {ip:d[.]d[.]d[.]d} a
connect to {ip:d [.] d [.] d [.] d} a
from {ip:d.d.d.d}/89 a a
card {card:L} a a
visa {card:L L4} a
credit card number {card:L} a
a a {card:L} a. a
karte {card:L} a
carte {card:L} a
a a a a a a a
a, a a. a a a
a a at a a dot a a
A A A A A A A
A!! A!! A,!! A.!! A!! A!!
A!! AT!! A!! A.!! TO!! A
a%%% a$$$ A### a*** 9!!
released under the A License
licensed under BY-NC 8.9
a a SPDX-A: A-8.9
under the A General A License, version 8
copyright 2008 a a
a to a at a, a on a from a
de de de de de de de de
at at at to to on on
A. a a. AA a A
a at a. a a at the a
the dot com a a a
a a | a | a a | a
a a 8999 a a
in 1999 a a 2008 a
a 89.99 a a
version 8.9.9 a a
a 8.9.9.9.9 a
section 8.9 a a
a N a a
a a N a. a
N a a
order N a a
id 8999999 a a
a 899999 a a
page 89 of 899
a 1999-09-09 a
09/09/1999 a a
a 89:99 a a
a 89% a, a 8,999
item 899-9999 a a
isbn 978-8-99-999999-9 a
a token = "9f9a9b9c9d" a
key 9a9b9c9d9e a a
a$$$ a### a*** a!!
call a a a a
mail a a a
phone a a, a
a @ a a
@a a a a
a card a a
a server a a a
tel a a a a
8. a a
9.9. a a
a a 8999 8999 a
table 8 9 8 9 a
a 899 a 899 a 9999
""".strip().splitlines()  # fmt: skip
#: The words that the table spells out.
CUES = frozenset(
    word for line in TEMPLATES for part in re.split(r"\{\w+:|\}", line) for word in (w.strip(".,:").lower() for w in part.split()) if len(word) > 1 and (word.isalpha() or SPELLED.fullmatch(word))
)
SLOT = re.compile(r"\{(\w+):([^}]*)\}")
PARTS = "the of and on er in ing ti re le de la que en el der die und ver ch ge ß é ö ción a st th nd ou ie or an".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(PARTS) for _ in range(r.randint(1, 4)))


def _card(r: random.Random, right: bool) -> str:
    digits = "".join(r.choice("0123456789") for _ in range(15))
    check = next(c for c in "0123456789" if luhn(digits + c))
    return digits + (check if right else r.choice([c for c in "0123456789" if c != check]))


def _filled(form: str, r: random.Random, inside: bool) -> str:
    """A form with its letters filled in. Outside of slots only whole one-letter words and digits stand for something."""

    def one(m: re.Match[str]) -> str:
        c = m.group()
        if c == "9":
            return r.choice("0123456789")
        if c == "8":
            return r.choice("123456789")
        if c == "A":
            return _word(r).upper()
        if c == "a":
            return _word(r) if r.random() < 0.9 or inside else _word(r).capitalize()
        if c == "h":
            return re.sub("[^a-z]", "o", _word(r))
        if c == "d":
            return str(r.randint(1, 255))
        if c == "L4":
            return ""
        return _card(r, c == "L")

    return re.sub(r"[89]|(?<![^\W\d_])(?:L4|[aAhdLN])(?![^\W\d_])", one, form).strip()


def examples(copies: int = 8, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """The labelled table: ``copies`` texts for each template, with their spans in code points, and plain ones of every cue."""
    r, out = random.Random(seed), []
    for line in TEMPLATES:
        for _ in range(copies):
            text, spans, at = "", [], 0
            for m in SLOT.finditer(line):
                text += _filled(line[at : m.start()], r, False) + " " if m.start() > at else ""
                value = _filled(m.group(2), r, True)
                if m.group(1) == "card" and r.random() < 0.3:
                    value = r.choice(" -").join(value[i : i + 4] for i in range(0, 16, 4))
                spans.append((m.group(1), len(text), len(text) + len(value)))
                text += value
                at = m.end()
            tail = _filled(line[at:], r, False)
            text += (" " if at and tail and tail[0] not in ".,:" else "") + tail
            out.append((text, spans))
    for cue in sorted(CUES):  # a cue alone says nothing, however often it stands there
        out += [(" ".join([form] * 6), []) for form in (cue, cue.capitalize())]
        out.append((" ".join(_word(r) if r.random() < 0.6 else cue for _ in range(12)), []))
    return out


# --- features ----------------------------------------------------------------------------------------------------------


def shape(word: str) -> str:
    """Runs of letters, capitals and digits with their lengths (up to 6), other characters once each (runs cut to two)."""
    out, last, run = [], "", 0
    for c in word[:64]:
        k = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if k == last:
            run += 1
        else:
            if last:
                out.append(f"{last}{min(run, 6)}" if last == "9" else last * min(run, 2))
            last, run = k, 1
    out.append(f"{last}{min(run, 6)}" if last == "9" else last * min(run, 2))
    return "".join(out)


EDGES = "\"'.,;:!?()[]{}<>|#$%&*=_-"


def own_features(word: str, cues: frozenset[str]) -> list[str]:
    """What is seen of a word by itself. Words of letters only are told apart by case and cue, others by their shape."""
    if word.isalpha() and len(word) > 1 and word.islower() and word not in cues:
        return ["letters", "lower"]
    core = word.strip(EDGES)
    cue = word.lower().strip(".,:;")
    found = [f"word={cue}"] if cue in cues else []
    digits = _digits(word)
    if not digits and "@" not in word:
        if core.isalpha():
            return found or ["letters", "capitals" if core.isupper() and len(core) > 1 else "letter" if len(core) == 1 else "lower" if core.islower() else "mixed"]
        return found or (["spelled"] if SPELLED.search(word) else ["signs", "nothing" if not core else "inner"])
    form = shape(core)
    found += [f"shape={form}", f"kind={re.sub('[0-9]', '', form.replace('9', '0'))}"]
    if digits:
        found.append(f"digits={min(len(digits), 20)}")
        if 13 <= len(digits) <= 19:
            found.append(f"luhn={luhn(digits)}")
        if core.count(".") == 3 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in core.split(".")):
            found.append("quad")
        found.append("number" if len(core) == len(digits) else "mixture")
        if any(c.isalpha() for c in core):
            found.append("letters and digits")
    return found + [f"has{c}" for c in "@([+" if c in word]


@dataclass
class Tagger:
    """Weights of features at the place before, at and behind a word (rows of L), transitions, starts and ends."""

    cues: frozenset[str]
    index: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def rows(self, features: tuple[str, ...]) -> np.ndarray:
        """Scores that a word of these features gives to its successor, itself and its predecessor: 3 x L."""
        out = np.zeros((3, len(LABELS)))
        for f in features:
            for place in range(3):
                i = self.index.get(f"{place}{f}")
                if i is not None:
                    out[place] += self.weights[i]
        return out

    def favours(self) -> tuple[float, float]:
        """By how much transitions can at most favour a run of other labels over O: for each of its words, and once for the run."""
        t, first, last = self.trans, self.first, self.last
        inner = float(t[1:, 1:].max() - t[0, 0])
        edges = max((t[0, 1:] - t[0, 0]).max(), (first[1:] - first[0]).max()) + max((t[1:, 0] - t[0, 0]).max(), (last[1:] - last[0]).max())
        return inner, float(edges) - inner


def _tagged(text: str, spans: list[Span]) -> tuple[list[str], list[int]]:
    words, tags, held = [], [], None
    for m in WORD.finditer(text):
        inside = next((s for s in spans if m.start() < s[2] and s[1] < m.end()), None)
        words.append(m.group())
        tags.append(0 if inside is None else LABELS.index(("I-" if inside == held else "B-") + inside[0]))
        held = inside
    return words, tags


def _sums(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(table: list[tuple[str, list[Span]]], cues: frozenset[str] = frozenset(), steps: int = STEPS) -> Tagger:
    """Train on (text, spans) rows, of which at most MAX_EXAMPLES are taken; ``cues`` are the words that are known by themselves.
    No rows give a tagger that finds nothing."""
    rows = [(w, t) for w, t in (_tagged(*row) for row in table[:MAX_EXAMPLES]) if w]
    width, n_labels = max((len(w) for w, _ in rows), default=1), len(LABELS)
    index: dict[str, int] = {}
    places: list[tuple[int, int, int]] = []
    for r, (words, _) in enumerate(rows):
        for i, w in enumerate(words):
            for f in own_features(w, cues):
                for place, t in enumerate((i + 1, i, i - 1)):
                    if 0 <= t < len(words):
                        places.append((r, t, index.setdefault(f"{place}{f}", len(index))))
    x = np.zeros((len(rows) * width, max(1, len(index))), dtype=np.float32)
    for r, t, f in places:
        x[r * width + t, f] += 1
    size = np.array([len(w) for w, _ in rows], dtype=np.int64)
    gold = np.zeros((len(rows), width), dtype=np.int64)
    for r, (_, tags) in enumerate(rows):
        gold[r, : len(tags)] = tags
    real = np.arange(width)[None] < size[:, None]
    onehot = np.eye(n_labels)[gold] * real[:, :, None]
    both = (real[:, 1:, None, None] * onehot[:, :-1, :, None] * onehot[:, 1:, None, :]).sum((0, 1))
    ends = np.eye(n_labels)[gold[np.arange(len(rows)), size - 1]].sum(0) if len(rows) else np.zeros(n_labels)
    starts = onehot[:, 0].sum(0) if len(rows) else np.zeros(n_labels)
    values = [np.zeros((x.shape[1], n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels), np.zeros(n_labels)]
    means, squares = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1 if rows else 1):
        weights, trans, first, last = values
        e = (x @ weights.astype(np.float32)).reshape(len(rows), width, n_labels).astype(np.float64)
        ahead = np.zeros((width, len(rows), n_labels))
        behind = np.zeros((width, len(rows), n_labels))
        ahead[0] = e[:, 0] + first
        for t in range(1, width):
            on = _sums(ahead[t - 1][:, :, None] + trans, 1) + e[:, t]
            ahead[t] = np.where(real[:, t, None], on, ahead[t - 1])
        behind[width - 1] = last
        for t in range(width - 2, -1, -1):
            on = _sums(trans + (behind[t + 1] + e[:, t + 1])[:, None, :], 2)
            behind[t] = np.where(real[:, t + 1, None], on, last)
        whole = _sums(ahead[width - 1] + last, 1)
        p = np.exp(ahead + behind - whole[None, :, None]).transpose(1, 0, 2) * real[:, :, None]
        pairs = np.exp(ahead[:-1][:, :, :, None] + trans + (behind[1:] + e.transpose(1, 0, 2)[1:])[:, :, None, :] - whole[None, :, None, None])
        pairs = (pairs * real.T[1:][:, :, None, None]).sum((0, 1))
        end_p = p[np.arange(len(rows)), size - 1].sum(0)
        slopes = [x.T @ (onehot - p).reshape(-1, n_labels).astype(np.float32), both - pairs, starts - p[:, 0].sum(0), ends - end_p]
        for v, m, s, g in zip(values, means, squares, slopes):
            g = g - PENALTY * v
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return Tagger(cues, index, *values)


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    """The tagger of the built-in table."""
    return fit(examples(), CUES)


# --- decoding ----------------------------------------------------------------------------------------------------------


def _viterbi(e: np.ndarray, size: np.ndarray, into: np.ndarray, out_of: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of stretches padded to one width: ``e`` is B x T x L, ``into`` and ``out_of`` are the scores at both edges (B x L)."""
    b, width, n = e.shape
    score = e[:, 0] + into
    back = np.zeros((width, b, n), dtype=np.int8)
    for t in range(1, width):
        step = score[:, :, None] + trans
        back[t] = step.argmax(1)
        on = step.max(1) + e[:, t]
        score = np.where((t < size)[:, None], on, score)
    label = (score + out_of).argmax(1)
    out = np.zeros((b, width), dtype=np.int8)
    for t in range(width - 1, -1, -1):
        live = t < size
        out[live, t] = label[live]
        if t:
            label = np.where(live, back[t, np.arange(b), label], label)
    return out


class _Ids(dict):
    """Word to the number of its row of scores; words with the same features share one."""

    def __init__(self, tagger: Tagger):
        super().__init__()
        self.tagger, self.classes, self.rows = tagger, {}, []

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        features = tuple(own_features(word, self.tagger.cues))
        at = self.classes.get(features)
        if at is None:
            at = self.classes[features] = len(self.rows)
            self.rows.append(self.tagger.rows(features))
        self[word] = at
        return at


class Decoder:
    """Labels words of whole texts; remembers the scores of distinct words."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger
        self.inner, self.edge = tagger.favours()
        self.ids = _Ids(tagger)

    def _scores(self, table: np.ndarray, ids: np.ndarray, at: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Scores of the words at some places, by label."""
        before, after = table[ids[np.maximum(at - 1, 0)], 0], table[ids[np.minimum(at + 1, len(ids) - 1)], 2]
        return table[ids[at], 1] + before * ~head[at][:, None] + after * ~tail[at][:, None]

    def _open(self, w: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The words that may have another label than O: those that stand in a stretch whose words together gain enough.

        A run of other labels replaced by O loses, for each word, at most ``w``, and at most ``edge`` besides. Best sums of
        stretches that end or begin at a word are differences of running sums; an offset for each text keeps them inside it.
        """
        sums = np.cumsum(w)
        apart = (sums.max() - sums.min() + np.abs(w).max() + 1) * text
        upto = sums - np.minimum.accumulate(sums - w - apart) - apart
        onward = np.maximum.accumulate((sums - apart)[::-1])[::-1] + apart - (sums - w)
        return np.flatnonzero(upto + onward - w + self.edge >= -1e-6)

    def labels(self, texts: list[list[str]]) -> list[tuple[int, int, int]]:
        """(text, word, label) of all words that aren't O."""
        if len(self.ids.rows) > MEMORY:
            self.ids = _Ids(self.tagger)
        sizes = np.array([len(w) for w in texts], dtype=np.int64)
        ids = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=sizes.sum())
        if not len(ids):
            return []
        table = np.array(self.ids.rows)
        text = np.repeat(np.arange(len(texts)), sizes)
        head = np.r_[True, text[1:] != text[:-1]]
        tail = np.r_[head[1:], True]
        w = np.empty(len(ids))
        for a in range(0, len(ids), PASS_WORDS):
            e = self._scores(table, ids, np.arange(a, min(len(ids), a + PASS_WORDS)), head, tail)
            w[a : a + len(e)] = e[:, 1:].max(1) - e[:, 0] + self.inner
        at = self._open(w, text)
        if not len(at):
            return []
        e = self._scores(table, ids, at, head, tail)
        begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])])
        size = np.diff(np.r_[begin, len(at)])
        t, found = self.tagger, []
        order = np.argsort(size, kind="stable")
        i = 0
        while i < len(order):
            # stretches of like length together, at most PASS_WORDS cells
            j = i + 1
            while j < len(order) and size[order[j]] <= 2 * size[order[i]] and (j - i + 1) * size[order[j]] <= PASS_WORDS:
                j += 1
            these = order[i:j]
            width = int(size[these].max())
            cell = np.minimum(begin[these][:, None] + np.arange(width)[None], len(at) - 1)
            from_, to = at[begin[these]], at[begin[these] + size[these] - 1]
            into = np.where(head[from_][:, None], t.first, t.trans[0])
            out_of = np.where(tail[to][:, None], t.last, t.trans[:, 0])
            best = _viterbi(e[cell], size[these], into, out_of, t.trans)
            r, c = np.nonzero(best)
            found += zip(at[cell[r, c]].tolist(), best[r, c].tolist())
            i = j
        starts = np.cumsum(sizes) - sizes
        return [(int(text[w]), int(w - starts[text[w]]), label) for w, label in sorted(found)]


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without signs at both edges that belong to the sentence; a bracket stays if its pair stands inside."""
    while start < end and text[start] in EDGES and not (text[start] == "(" and ")" in text[start:end]):
        start += 1
    while end > start and text[end - 1] in EDGES and not (text[end - 1] in ")]" and "([".__getitem__(")]".index(text[end - 1])) in text[start:end]):
        end -= 1
    return start, end


def found_spans(text: str, labels: list[tuple[int, int]], base: list[Span]) -> list[Span]:
    """The base spans and those of the labels (word, label) that touch none of them, by kind and start."""
    places = [m.span() for m in WORD.finditer(text)]
    spans: list[list] = []
    for word, label in labels:
        edge, kind = LABELS[label].split("-")
        if edge == "I" and spans and spans[-1][0] == kind and spans[-1][3] == word - 1:
            spans[-1][2:] = [places[word][1], word]
        else:
            spans.append([kind, *places[word], word])
    out = list(base)
    for kind, start, end, _ in spans:
        start, end = _trimmed(text, start, end)
        if start < end and all(end <= s or e <= start for _, s, e in base):
            out.append((kind, start, end))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _find(tagger: Tagger, names: list[str]):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tagger)
        for batch in batches:
            base, spans = [], []
            group: list[tuple[str, list[Span], list[str]]] = []
            held = 0

            def flush() -> None:
                labels: list[list[tuple[int, int]]] = [[] for _ in group]
                for i, word, label in decoder.labels([g[2] for g in group]):
                    labels[i].append((word, label))
                for (text, exact, _), own in zip(group, labels):
                    base.append(exact)
                    spans.append(found_spans(text, own, exact) if own else sorted(exact, key=lambda s: KINDS.index(s[0])))
                group.clear()

            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                text = text or ""
                words = WORD.findall(text)
                group.append((text, base_spans(text), words))
                held += len(words)
                if held >= PASS_WORDS:
                    flush()
                    held = 0
            flush()
            row = lambda found: [{"kind": k, "start": s, "end": e} for k, s, e in found]
            made = {"base_spans": pa.array([row(b) for b in base], kind), "spans": pa.array([row(s) for s in spans], kind)}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)

    return run


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Every row of ``docs`` with ``base_spans`` and ``spans``, arrays of (kind, start, end) by kind and start, in code points
    with the end exclusive.

    ``base_spans`` are leftmost, non-overlapping matches of each kind's pattern that pass its test; ``spans`` holds them all and
    what the random field finds besides, where it touches none of them. Null and empty texts have none. Each row stands for
    itself, ids aren't used. Input columns of those names are replaced, others pass through. An empty table gives an empty
    table. Texts of any length are read whole.
    """
    docs = docs.drop("base_spans", "spans")
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("base_spans", kind), T.StructField("spans", kind)])
    return docs.mapInArrow(_find(tagger or default_tagger(), schema.names), schema)
