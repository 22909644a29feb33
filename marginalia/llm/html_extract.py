"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags. Each block becomes a
vector of hashed tag-path steps (tags, class and id words of its ancestors), hashed words and a
few lengths. A bidirectional LSTM in numpy reads the vectors of the whole page in order and
labels each block as article text or not, so a block's label depends on the whole document.

The network is trained here, on pages composed at random (see ``compose``) whose labels are
known; nothing is read from the corpus for it. Training is seeded, takes a few seconds and
gives the same weights each time.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATH_DIMS, WORD_DIMS, EXTRA = 96, 32, 6
DIMS = PATH_DIMS + WORD_DIMS + EXTRA
HIDDEN = 16
#: Blocks of text labelled at once: bounds the memory of a batch.
LABEL_CELLS = 60_000
#: Hashed paths kept while pages are read.
KNOWN_PATHS = 1 << 14

#: HTML elements that start a new block, those that hold no text, and void ones.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template textarea iframe svg math object xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the same kind (or, for p, any block does).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"button", "label", "option", "optgroup", "caption", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "title", "head", "html", "body"}
SCOPE = frozenset(("table", "ul", "ol", "dl", "td", "th", "article", "section", "div", "body", "aside", "nav", "main", "form"))

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
STOP = re.compile(r"[>\"']")
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z]+")


DIGIT = re.compile(r"\d")
ENDINGS = frozenset(".!?…\"'”»")
BYTE_HASH = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)
PLACE_HASH = np.random.default_rng(6).integers(0, 1 << 31, 64, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def tag_end(page: str, at: int) -> int:
    """Where the tag ends whose name ends at ``at``: behind the first > outside of quotes, or, if a quote isn't
    closed, behind the first > after it. -1: there is none. What is looked at is the tag itself, so a page is read once."""
    while stop := STOP.search(page, at):
        if stop[0] == ">":
            return stop.end()
        closing = page.find(stop[0], stop.end())
        if closing < 0:
            return page.find(">", stop.end()) + 1 or -1
        at = closing + 1
    return -1


def _with_step(buckets: tuple[int, ...], steps: tuple[str, ...], known: dict) -> tuple[int, ...]:
    if (buckets, steps) not in known:
        if len(known) >= KNOWN_PATHS:
            known.clear()
        known[buckets, steps] = _hashed(buckets, steps)
    return known[buckets, steps]


def _hashed(buckets: tuple[int, ...], steps: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(sorted({*buckets, *(zlib.crc32(step.encode("utf-8", "replace")) % PATH_DIMS for step in steps)}))


def leaf_blocks(page: str, known: dict | None = None) -> list[tuple[tuple[int, ...], int, str, int]]:
    """(hashed steps of the path, their number, text, characters in links) for each block with text, in page order.

    Character references are decoded and white space runs become one space. An unclosed element
    ends where an ancestor ends; comments, scripts, styles and the like have no text. A tag that never ends is text.
    ``known`` keeps hashed paths from page to page.
    """
    known = {} if known is None else known
    found: list[tuple[tuple[int, ...], int, str, int]] = []
    #: open elements: name, hashed steps down to it, number of these steps, number of open blocks
    stack: list[tuple[str, tuple[int, ...], int, int]] = []
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, buckets, depth, _ = stack[-1] if stack else ("", (), 0, 0)
                found.append((buckets, depth, text, linked))
            parts.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal links
        for name, *_ in stack[at:]:
            open_names[name] -= 1
            links -= name == "a"
        del stack[at:]

    def said(piece: str) -> None:
        nonlocal linked
        if piece:
            if "&" in piece:
                piece = html.unescape(piece)
            parts.append(piece)
            if links > 0:
                linked += len(piece)

    at = 0
    search = TAG.search
    while True:
        tag = search(page, at)
        end = tag_end(page, tag.end()) if tag and tag[2] else 0
        if not tag or end < 0:
            said(page[at:])
            break
        said(page[at : tag.start()])
        at = end or tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if open_names[name]:
                where = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                if name in BLOCK or stack[-1][3] > (stack[where - 1][3] if where else 0):
                    flush()
                close(where)
            elif name in BLOCK:
                flush()
            continue
        if name in RAW:
            over = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = over.end() if over else len(page)
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCK:
            flush()
            shut = CLOSES.get(name, frozenset()) | ({"p"} if name in ENDS_P else frozenset())
            for i in range(len(stack) - 1, -1, -1) if any(open_names[n] for n in shut) else ():
                if stack[i][0] in shut:
                    close(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        attributes = page[tag.end() : at - 1]
        if not attributes.rstrip().endswith("/"):
            steps = [name]
            if "=" in attributes:
                for m in ATTR.finditer(attributes):
                    steps += [f".{w}" for w in NAME.findall((m[1] or m[2] or m[3] or "").lower())]
            _, buckets, depth, blocks = stack[-1] if stack else ("", (), 0, 0)
            stack.append((name, _with_step(buckets, tuple(steps), known), depth + len(steps), blocks + (name in BLOCK)))
            open_names[name] += 1
            links += name == "a"
    flush()
    return found


def _word_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, WORD_DIMS) counts of hashed words, and the number of words of each block.

    All words are hashed at once: a sum over a word's bytes of a random number for the byte times
    one for its place in the word.
    """
    raw = np.frombuffer(("\n".join(texts)).lower().encode("utf-8", "replace"), dtype=np.uint8)
    gap = (raw == 32) | (raw == 10)
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
    mixed = BYTE_HASH[raw] * PLACE_HASH[np.minimum(place, 63)]
    mixed[gap] = 0
    words = (np.add.reduceat(mixed, starts) >> np.uint32(20)) % np.uint32(WORD_DIMS)
    block = np.cumsum(raw == 10)[starts]
    counts = np.bincount(block * WORD_DIMS + words.astype(np.int64), minlength=len(texts) * WORD_DIMS).reshape(-1, WORD_DIMS)
    return counts, counts.sum(axis=1)


def vectors(blocks: list[tuple[tuple[int, ...], int, str, int]]) -> np.ndarray:
    """One row per block; the blocks may be those of many pages."""
    if not blocks:
        return np.zeros((0, DIMS), dtype=np.float32)
    dense = np.zeros((len(blocks), DIMS), dtype=np.float32)
    counts, n_words = _word_counts([text for _, _, text, _ in blocks])
    dense[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts * (4.0 / (n_words + 3))[:, None]
    lengths = np.array([len(text) for _, _, text, _ in blocks])
    dense[:, -6] = np.log1p(n_words) / 4
    dense[:, -5] = np.array([linked for _, _, _, linked in blocks]) / (lengths + 1)
    dense[:, -4] = [text[-1] in ENDINGS for _, _, text, _ in blocks]
    dense[:, -3] = n_words < 4
    dense[:, -2] = [DIGIT.search(text, 0, 50) is not None for _, _, text, _ in blocks]
    rows: list[int] = []
    steps: list[int] = []
    for row, (buckets, _, _, _) in enumerate(blocks):
        steps += buckets
        rows += [row] * len(buckets)
    dense[:, -1] = np.array([depth for _, depth, _, _ in blocks]) / 12
    dense[rows, steps] = 1.0
    return dense


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one for each direction, and a logistic layer over both states."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"x{d}"] = (rng.normal(size=(DIMS, 4 * hidden)) * 0.15).astype(np.float32)
            self.w[f"h{d}"] = (rng.normal(size=(hidden, 4 * hidden)) * 0.15).astype(np.float32)
            bias = np.zeros(4 * hidden, dtype=np.float32)
            bias[hidden : 2 * hidden] = 1.0
            self.w[f"b{d}"] = bias
        self.w["o"] = (rng.normal(size=2 * hidden) * 0.15).astype(np.float32)
        self.w["c"] = np.zeros(1, dtype=np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: (time, batch, DIMS), already reversed for the backward direction."""
        steps, batch, _ = x.shape
        h = self.h
        state = np.zeros((batch, h), dtype=np.float32)
        cell = np.zeros((batch, h), dtype=np.float32)
        out = np.zeros((steps, batch, h), dtype=np.float32)
        gates_in = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        for t in range(steps):
            z = gates_in[t] + state @ self.w[f"h{d}"]
            i, f, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            new_cell = m * (f * cell + i * g) + (1 - m) * cell
            tanh_cell = np.tanh(new_cell)
            new_state = m * (o * tanh_cell) + (1 - m) * state
            if keep is not None:
                keep.append((i, f, o, g, cell, tanh_cell, state, m))
            state, cell = new_state, new_cell
            out[t] = state
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        forward = self._run("f", x, mask)
        backward = self._run("b", x[::-1], mask[::-1])[::-1]
        return _sigmoid(np.concatenate([forward, backward], axis=2) @ self.w["o"] + self.w["c"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        h = self.h
        kept: dict[str, list] = {"f": [], "b": []}
        states = {"f": self._run("f", x, mask, kept["f"]), "b": self._run("b", x[::-1], mask[::-1], kept["b"])}
        both = np.concatenate([states["f"], states["b"][::-1]], axis=2)
        p = _sigmoid(both @ self.w["o"] + self.w["c"])
        n = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
        top = (mask * (p - y) / n).astype(np.float32)
        grads = {"o": np.einsum("tb,tbh->h", top, both), "c": np.array([top.sum()], dtype=np.float32)}
        for d, part in (("f", self.w["o"][:h]), ("b", self.w["o"][h:])):
            inputs = x if d == "f" else x[::-1]
            down = top if d == "f" else top[::-1]
            d_gates = np.zeros((len(x), x.shape[1], 4 * h), dtype=np.float32)
            d_state = np.zeros((x.shape[1], h), dtype=np.float32)
            d_cell = np.zeros_like(d_state)
            grad_h = np.zeros_like(self.w[f"h{d}"])
            for t in range(len(x) - 1, -1, -1):
                i, f, o, g, cell, tanh_cell, state, m = kept[d][t]
                d_out = (d_state + down[t][:, None] * part) * m
                through = d_cell * m + d_out * o * (1 - tanh_cell**2)
                z = np.concatenate([through * g * i * (1 - i), through * cell * f * (1 - f), d_out * tanh_cell * o * (1 - o), through * i * (1 - g**2)], axis=1)
                d_gates[t] = z
                grad_h += state.T @ z
                # where a page has ended, nothing but its own padding is passed on
                d_state = z @ self.w[f"h{d}"].T + (d_state + down[t][:, None] * part) * (1 - m)
                d_cell = through * f + d_cell * (1 - m)
            flat = d_gates.reshape(-1, 4 * h)
            grads |= {f"x{d}": inputs.reshape(-1, DIMS).T @ flat, f"b{d}": flat.sum(axis=0), f"h{d}": grad_h}
        return loss, grads

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, which blocks are article text. Pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            take = 1
            while at + take < len(order) and take < 512 and len(pages[order[at + take]]) * (take + 1) <= LABEL_CELLS:
                take += 1
            chosen = order[at : at + take]
            x, mask = pad([pages[i] for i in chosen])
            if x.shape[0]:
                found = self.scores(x, mask) >= 0.5
                for k, i in enumerate(chosen):
                    out[i] = found[: len(pages[i]), k]
            at += take
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), DIMS), dtype=np.float32)
    mask = np.zeros((steps, len(pages)), dtype=np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k] = page
        mask[: len(page), k] = 1
    return x, mask


#: Names that web pages give to parts that are not the article, with what such parts say.
PARTS = {
    "nav": ("nav menu navbar navigation topnav breadcrumb breadcrumbs tabs pagination pager", "home about contact products news archive next previous page search login"),
    "header": ("header masthead banner topbar site branding logo", "welcome to our site the official daily home sign in"),
    "footer": ("footer bottom colophon copyright legal sitefooter", "copyright all rights reserved privacy policy terms of use imprint contact"),
    "aside": ("sidebar aside widget related recommended trending popular rail promo", "related articles most read popular posts you may also like tags"),
    "ad": ("ad ads advert advertisement adsbygoogle sponsor sponsored promo banner", "advertisement sponsored buy now limited offer click here sale"),
    "notice": ("cookie consent notice alert gdpr popup modal newsletter overlay message", "we use cookies accept decline subscribe to our newsletter this site uses"),
    "form": ("form search login signup subscribe", "email name submit send search password subscribe"),
    "share": ("share social sharing tools toolbar actions byline meta", "share tweet facebook print email like follow us"),
    "comments": ("comments comment reply responses discussion disqus thread", "reply says comment great post thanks for sharing anonymous said leave a comment"),
}
SOUNDS = "the in er on an re th nd at ed ha es ing ou is it or ti hi st ar te se le al de en ra ch un die der ion la que os".split()


def _words(rng: random.Random, n: int, said: str = "") -> str:
    known = said.split()
    return " ".join(rng.choice(known) if known and rng.random() < 0.5 else "".join(rng.choice(SOUNDS) for _ in range(rng.randint(1, 4))) for _ in range(n))


def _sentence(rng: random.Random, n: int) -> str:
    text = _words(rng, n).capitalize()
    if rng.random() < 0.15:
        text = re.sub(r"\b(\w+)", lambda m: m[1] + rng.choice(["&amp;&amp;&amp;", "%%%", "***", "$$$", "###"]), text)
    return text + rng.choice([".", ".", ".", "!", "?", ""])


def compose(rng: random.Random) -> str:
    """A random page. Text of the article carries the mark U+E000 at the start of each block."""

    def part(kind: str, inside: bool = False) -> str:
        names, said = PARTS[kind]
        names = names.split()
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        if tag != "form" and rng.random() < (0.5 if not inside else 0.8):
            tag = rng.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        attr = f' class="{rng.choice(names)}{rng.choice(["", "-box", " col", "-wrap"])}"'
        if tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6:
            attr = ""
        elif rng.random() < 0.3:
            attr = f' id="{rng.choice(names)}"'
        n = rng.randint(1, 7)
        if kind == "nav" or (kind in ("aside", "share") and rng.random() < 0.5):
            items = "".join(f"<li><a href='/{i}'>{_words(rng, rng.randint(1, 3), said)}</a></li>" for i in range(n))
            body = items if tag == "ul" else f"<ul>{items}</ul>"
        elif kind == "form":
            body = "".join(f"<label>{_words(rng, 1, said)}</label><input name=x>" for _ in range(n)) + f"<button>{_words(rng, 1, said)}</button>"
        elif kind == "comments":
            body = f"<h3>{_words(rng, 1, said)}</h3>" * rng.randint(0, 1) + "".join(f"<div class='{rng.choice(['comment', 'reply', 'c'])}'><p>{_sentence(rng, rng.randint(3, 40))}</p></div>" for _ in range(n))
        else:
            body = "".join(rng.choice(["<p>{}</p>", "{}<br>", "<div>{}</div>", "{} "]).format(("&copy; " if kind == "footer" and rng.random() < 0.5 else "") + _sentence(rng, rng.randint(1, 18)) + (" " + _words(rng, 2, said) if rng.random() < 0.5 else "")) for _ in range(1 + n // 2))
        return f"<{tag}{attr}>{body}</{tag}>"

    def main() -> str:
        title = f"<h1>\ue000{_sentence(rng, rng.randint(1, 12))}</h1>"
        bits = [title] if rng.random() < 0.9 else []
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20])):
            k = rng.random()
            text = _sentence(rng, rng.choice([1, 2, 4, 8, 20, 40, 80]))
            if k < 0.72:
                bits.append(rng.choice(["<p>\ue000{}</p>", "<p>\ue000{}", "<p><b>\ue000{}<br>", "<p>\ue000{} <a href='/x'>link</a> and</p>", "<p>\ue000{} <em>so</em></p>"]).format(text))
            elif k < 0.8:
                bits.append(f"<h2>\ue000{_words(rng, rng.randint(1, 6))}</h2>")
            elif k < 0.87:
                bits.append("<ul>" + "".join(f"<li>\ue000{_sentence(rng, rng.randint(1, 12))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif k < 0.91:
                bits.append(f"<blockquote>\ue000{text}</blockquote>")
            elif k < 0.94:
                bits.append("<table>" + "".join(f"<tr><td>\ue000{_words(rng, 2)}</td><td>\ue000{_words(rng, 1)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                bits.append(part(rng.choice(["ad", "share", "aside", "notice", "form"]), inside=True))
        if rng.random() < 0.25:
            bits.append(part(rng.choice(["share", "comments", "aside"]), inside=True))
        k = rng.random()
        start, end = ("<article>", "</article>") if k < 0.55 else ("<main>", "</main>") if k < 0.7 else (f'<div class="{rng.choice(["content", "post", "entry", "article body", "story", "text"])}">', "</div>")
        return start + "".join(bits) + end

    before = [part(k) for k in ("nav", "header", "notice", "ad", "aside", "form") if rng.random() < 0.45]
    after = [part(k) for k in ("comments", "aside", "ad", "share", "form", "notice") if rng.random() < 0.3]
    rng.shuffle(before)
    rng.shuffle(after)
    if rng.random() < 0.3:
        before, after = ["<nav><ul>" + "".join(f'<li><a href="/{i}">{_words(rng, 1)}</a></li>' for i in range(rng.randint(2, 8))) + "</ul></nav>", f'<div class="ad">{_sentence(rng, rng.randint(1, 12))}</div>'], []
    if rng.random() < 0.85:
        after.append(part("footer") if rng.random() < 0.6 else f"<footer>&copy; {_words(rng, 1)}.example &middot; {_sentence(rng, rng.randint(1, 14))}</footer>")
    body = "".join(before) + main() + "".join(after)
    if rng.random() < 0.3:
        body = f"<div class='{rng.choice(['page', 'wrap', 'container'])}'>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{_words(rng, 5)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def sample_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of composed pages."""
    rng = random.Random(seed)
    found = []
    for _ in range(n):
        blocks = leaf_blocks(compose(rng))
        bare = [(buckets, depth, text.replace("\ue000", ""), linked) for buckets, depth, text, linked in blocks]
        worded = [i for i, (_, _, text, _) in enumerate(bare) if text.strip()]
        found.append((vectors([bare[i] for i in worded]), np.array([blocks[i][2].startswith("\ue000") for i in worded], dtype=np.float32)))
    return [(x, y) for x, y in found if len(x)]


@lru_cache(maxsize=1)
def trained(pages: int = 1500, epochs: int = 6, seed: int = 11) -> Labeller:
    """The labeller, fitted with Adam. Deterministic; cached for the life of the process."""
    net = Labeller()
    data = sample_pages(pages, seed)
    order = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(w) for k, w in net.w.items()}
    step, size = 0, 32
    for epoch in range(epochs):
        rows = sorted(range(len(data)), key=lambda i: (len(data[i][0]) + order.integers(0, 6)))
        groups = [rows[i : i + size] for i in range(0, len(rows), size)]
        order.shuffle(groups)
        for group in groups:
            x, mask = pad([data[i][0] for i in group])
            y = np.zeros_like(mask)
            for k, i in enumerate(group):
                y[: len(data[i][1]), k] = data[i][1]
            _, grads = net.gradients(x, mask, y)
            step += 1
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            rate = 0.01 * (0.5 ** max(0, epoch - 2)) * min(1.0, 1.0 / (norm + 1e-8))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return net


def extract(net: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page: its article blocks, joined by newlines."""
    known: dict = {}
    blocks = [leaf_blocks(p or "", known) for p in pages]
    ends = np.cumsum([len(b) for b in blocks])
    labels = net.label(np.split(vectors([x for b in blocks for x in b]), ends[:-1]))
    return ["\n".join(text for (_, _, text, _), main in zip(b, y) if main) for b, y in zip(blocks, labels)]


def _extract_rows(net: Labeller, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.schema.get_field_index("html")).to_pylist()
            texts: list[str] = []
            for start in range(0, len(pages), 512):
                texts += extract(net, pages[start : start + 512])
            made = {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)

    return run


def extract_text(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """Every row of ``pages`` with ``text``, the main text of ``html``.

    A null or empty page, or one without article blocks, has an empty text. Pages of any length
    are read whole. An input column ``text`` is replaced; others pass through. Repeated rows get
    equal texts. An empty table gives an empty table.
    """
    pages = pages.drop("text")
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())])
    return pages.mapInArrow(_extract_rows(net or trained(), schema.names), schema)


def text_length(df: DataFrame) -> DataFrame:
    """``n_chars``, the code points of ``text``, null for a null text. A column of that name is replaced."""
    return df.withColumn("n_chars", F.char_length("text").cast("long"))
