"""Plain versions of the contracts, for small fixtures."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def line_dedup(docs, min_chars=40, min_docs=5):
    key = lambda line: line.strip(WS).translate(LOWER)
    holders = defaultdict(list)
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(i)
    keep = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (keep.get(key(x)) is not None and keep[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def simhash(docs, width=3):
    fps = [fingerprint(t, width) for _, t in docs]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    root = components(len(docs), links)
    low = {}
    for (i, _), r in zip(docs, root):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [(i, f"{f:016x}", low.get(r)) for (i, _), f, r in zip(docs, fps, root)]


def words10(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, size=10):
    windows = defaultdict(set)
    for i, text in items:
        w = words10(text)
        if i is None or not w:
            continue
        for s in range(max(1, len(w) - size + 1)):
            windows[tuple(w[s : s + size])].add(str(i))
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, found = words10(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def nearest(rows, queries, k=10):
    ok = [(i, np.asarray(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None for x in v) and np.isfinite(np.asarray(v, dtype=float)).all() and any(v)]
    out = []
    for q, v in ok:
        if q in queries:
            near = sorted({(float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in ok if i != q and len(w) == len(v)})[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return out


def mix(docs, budget_percent=60, max_epochs=2, weights=None, domain=None):
    """docs: (id, tokens, domain, lang, source). Returns leaf -> share, by repeated water filling."""
    size = defaultdict(int)
    for _, n, *leaf in docs:
        size[tuple(leaf)] += n
    weights = weights or (lambda level, name: 1)

    def split(budget, children, level):
        room = {c: sum(v * max_epochs for leaf, v in size.items() if leaf[: level + 1] == c) for c in children}
        share, open_ = {}, set(children)
        left = budget
        while open_:
            total = sum(weights(level, c[-1]) for c in open_)
            full = {c for c in open_ if left * weights(level, c[-1]) >= room[c] * total}
            if not full:
                for c in open_:
                    share[c] = left * weights(level, c[-1]) // total
                break
            least = min(full, key=lambda c: (room[c] / weights(level, c[-1]), c[-1]))
            share[least] = room[least]
            left -= room[least]
            open_ -= {least}
        return share

    now = {(): sum(size.values()) * budget_percent // 100}
    for level in range(3):
        nxt = {}
        for parent, budget in now.items():
            kids = sorted({leaf[: level + 1] for leaf in size if leaf[:level] == parent})
            nxt |= split(budget, kids, level)
        now = nxt
    return now


def repeated_passages(docs, min_bytes=160, extend=256):
    """(id, start, end, row): op5's passages by plain dictionaries over all chunks, one document at a time."""
    from marginalia.llm.substring_dedup import chunks

    texts = {(i is None, -1 if i is None else i, t or ""): (t or "").encode() for i, t in docs}
    cut = {k: list(zip(c.tolist(), c.tolist()[1:])) for k, t in texts.items() for c in [chunks(t)[0]]}
    holders = defaultdict(list)
    for k, spans in cut.items():
        for a, b in spans:
            holders[texts[k][a:b]].append((k[:2], k, a))
    out = []
    for k, t in texts.items():
        found = set()
        for a, b in cut[k]:
            who = holders[t[a:b]]
            if len({x[1] for x in who}) < 2:
                continue
            low = min(x[:1] for x in who)[0]
            tied = {x[1] for x in who if x[0] == low}
            assert len(tied) == 1, "ties between texts of one id need their hashes"
            _, f, fa = min(x for x in who if x[0] == low)
            if f == k:
                continue
            # walk out from this chunk alone: a run's chunks all lead to the same passage, up to ``extend`` beyond its ends
            s, fs, e, fe = a, fa, b, fa + b - a
            own = {(x, y) for x, y in cut[k]}
            firsts = lambda x, y: min(h for h in holders[t[x:y]] if h[0] == min(z[0] for z in holders[t[x:y]]))
            def joins(x, y):
                if (x, y) not in own or len({z[1] for z in holders[t[x:y]]}) < 2:
                    return False
                _, g, ga = firsts(x, y)
                return g == f and x - ga == a - fa
            grown = True
            while grown:
                grown = False
                for x, y in cut[k]:
                    if (y == s or x == e) and joins(x, y):
                        s, e, grown = min(s, x), max(e, y), True
            fs, fe = s - a + fa, e - a + fa
            n = 0
            while n < extend and s > 0 and fs > 0 and t[s - 1] == texts[f][fs - 1]:
                s, fs, n = s - 1, fs - 1, n + 1
            n = 0
            while n < extend and e < len(t) and fe < len(texts[f]) and t[e] == texts[f][fe]:
                e, fe, n = e + 1, fe + 1, n + 1
            if e - s >= min_bytes:
                found.add((s, e))
        out += [(None if k[0] else k[1], a, b, k) for a, b in sorted(found)]
    return out


def without_passages(docs, passages):
    for i, t in docs:
        gone = bytearray((t or "").encode())
        keep = [True] * len(gone)
        for _, a, b, k in passages:
            if k == (i is None, -1 if i is None else i, t or ""):
                keep[a:b] = [False] * (b - a)
        yield i, t if t is None else bytes(c for c, ok in zip(gone, keep) if ok).decode("utf-8", "ignore")


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def copies(sets, least=0.8):
    """Greedily in the given order: which sets are similar to an earlier one that stays."""
    stay, gone = [], []
    for s in sets:
        gone.append(any(jaccard(s, k) >= least - 1e-9 for k in stay))
        if not gone[-1]:
            stay.append(s)
    return gone


def without_near_copies(docs, width=5):
    rows = sorted({(d[0] is None, -1 if d[0] is None else d[0], d[1] or ""): d for d in docs}.values(), key=lambda d: (d[0] is None, -1 if d[0] is None else d[0]))
    words = [(t or "").translate(LOWER).split() for _, t in rows]
    sets = [{" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in words]
    return [d for d, g in zip(rows, copies(sets)) if not g]


def toxicity(text, lexicon):
    """The score by looking for every pattern at every place."""
    from marginalia.llm.toxicity import fold

    folded = " " + " ".join(fold(text or "").split()) + " "
    at = lambda p: [i for i in range(len(folded)) if folded.startswith(p, i)]
    best = {}
    for pattern, weight in lexicon.weights.items():
        for i in at(pattern):
            best[i] = max(best.get(i, 0), weight)
    for phrase in lexicon.exceptions:
        p = f" {fold(phrase)} "
        for i in at(p):
            best = {k: w for k, w in best.items() if not i <= k < i + len(p) - 1}
    total, bias, a, b, c = sum(best.values()), *lexicon.curve
    words = max(folded.count(" ") - 1, 0)
    x = bias + (a * np.log(1 + total) + b * 20 * total / (20 + words) + c * max(best.values()) if best else 0)
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def language(text, dictionaries):
    """The language whose dictionary gives the smallest size, the first of equal ones."""
    import zstandard

    words = "".join(ch.lower() if ch.isalpha() else " " for ch in text or "").split()
    if not words:
        return "und"
    bare = " ".join(w for i, w in enumerate(words) if not i or w != words[i - 1]).encode()
    sizes = {}
    for lang, raw in dictionaries.items():
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=9)
        sizes[lang] = sum(len(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress(bare[i : i + 8192])) for i in range(0, len(bare), 8192))
    return min(sizes, key=lambda k: (sizes[k], list(sizes).index(k)))


def block_scores(net, x):
    """A bidirectional LSTM, unit by unit."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    w, n = net.w, net.h

    def states(d, rows):
        out, state, cell = [], np.zeros(n), np.zeros(n)
        for row in rows:
            z = [sum(row[k] * w[f"x{d}"][k, j] for k in np.flatnonzero(row)) + w[f"b{d}"][j] + float(state @ w[f"h{d}"][:, j]) for j in range(4 * n)]
            cell = np.array([sigmoid(z[n + j]) * cell[j] + sigmoid(z[j]) * np.tanh(z[3 * n + j]) for j in range(n)])
            state = np.array([sigmoid(z[2 * n + j]) * np.tanh(cell[j]) for j in range(n)])
            out.append(state)
        return out

    both = zip(states("f", x), states("b", x[::-1])[::-1])
    return [sigmoid(float(np.concatenate([f, b]) @ w["o"] + w["c"][0])) for f, b in both]


def mixed(docs, how):
    """docs: (id, text, lang, source). The chosen rows (id, domain, lang, source, tokens, epochs)."""
    domain = lambda source: f"d{int(hashlib.md5((source or '').encode()).hexdigest()[0], 16) % 4}"
    flat = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t)), domain(s), lang or "", s or "") for i, t, lang, s in docs if t and t.split()]
    names = [how.domains, how.langs, how.sources]
    out = []
    for leaf, share in mix(flat, how.budget_percent, how.max_epochs, lambda level, n: names[level].get(n, 1)).items():
        own = [x for x in flat if tuple(x[2:]) == leaf]
        tokens = sum(x[1] for x in own)
        key = {x[0]: hashlib.md5(f"{how.seed}:{share // tokens}:{'' if x[0] is None else x[0]}".encode()).hexdigest() for x in own}
        for x in own:
            n = share // tokens + (sum(y[1] for y in own if key[y[0]] <= key[x[0]]) <= share % tokens)
            if n:
                out.append((x[0], *leaf, x[1], n))
    return out
