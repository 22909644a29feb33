"""Text functions as Column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character classes and word lists that decide results.
CJK = r"一-鿿"
CJK_WIDE = r"㐀-䶿一-鿿豈-﫿"
CJK_PUNCT = "，。、；：？！“”‘’（）《》【】…—～·「」『』"
EXOTIC = r"ऀ-ॿঀ-৿ༀ-࿿؀-ۿ֐-׿฀-๿"
COMMON_WORDS = (
    "the", "and", "of", "to", "in", "is", "are", "was", "were", "for", "with", "that", "this", "as", "on", "by", "be", "an", "we", "it",
    "from", "at", "which", "can", "has", "have", "not", "but", "or", "its", "their", "our", "these", "than", "also", "such", "may",
)
#: Rules for the kind of a section, first match wins.
SECTION_RULES = (
    (r"(?i)参\s*考\s*文\s*献|references?", "refs"),
    (r"(?i)致\s*谢|acknowledg", "ack"),
    (r"攻读学位期间|科研成果|发表论文|成果清单", "ack"),
    (r"(?i)附\s*录|appendix", "appendix"),
    (r"(?i)目\s*录|table of contents", "toc"),
    (r"(?i)研究现状|综述|related work|literature review|国内外.{0,6}(进展|现状)", "review"),
)
INHERITED_KINDS = ("refs", "ack", "toc", "appendix")
UNINDEXED_KINDS = ("toc", "refs", "ack", "appendix")
#: The beginnings of lines of a journal's copyright block.
COPYRIGHT_LINE = r"^\s*(?:https?://|E-?mail\b|Tel\b|ISSN\b|DOI\s*[:：]|收稿日期|基金项目|中图分类号|文献标志码|文章编号)"

#: White space of any kind; the look-ahead changes no match and passes by what is plainly none.
SPACE = r"(?U)(?![!-~])\s+"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def regex_count(text: Column, pattern: str) -> Column:
    """Number of matches, without building them."""
    return F.regexp_count(_text(text), F.lit(pattern))


def strip_cjk_spacing(text: Column) -> Column:
    """Spaces between two CJK characters or their punctuation go. Look-around makes one pass enough."""
    side = f"[{CJK_WIDE}{CJK_PUNCT}]"
    return F.regexp_replace(_text(text), f"(?<={side}) +(?={side})", "")


def strip(text: Column) -> Column:
    """White space of any kind off both ends; only the ends are read."""
    return F.btrim(_text(text), F.lit(SPACES))


def split_at(text: Column, pattern: str) -> Column:
    """split, with the pattern compiled once: Spark's split compiles a pattern of more than one character for every row.

    Matches become U+FFFF, which a text of its own gives away for U+FFFE; neither is a character.
    """
    return F.split(F.regexp_replace(F.replace(text, F.lit("\uffff"), F.lit("\ufffe")), pattern, "\uffff"), "\uffff")


def clean_text(text: Column) -> Column:
    """PDF noise: line ends, space runs, CJK spacing, hyphenated breaks, page numbers and stray marks.

    Blank lines go too. Null gives an empty text.
    """
    t = F.regexp_replace(_text(text), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t ]+", " ")
    t = strip_cjk_spacing(t)
    t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    noise = lambda x: x.rlike(r"(?U)^\d{1,4}$") | ((F.length(x) <= 2) & ~x.rlike(r"^[\p{L}\p{N}]+$"))
    kept = F.array_join(F.filter(lines, lambda x: ~noise(x)), "\n")
    return strip(F.regexp_replace(kept, r"\n{3,}", "\n\n"))


#: Named character references that notes use.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    """Named references in ENTITIES; ``&amp;`` last, so that what it makes isn't decoded again."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_to_markdown(raw: Column) -> Column:
    """Notes in HTML to Markdown: known tags are rewritten in a fixed order, others stripped."""
    t = _text(raw)
    t = F.regexp_replace(t, r'<img[^>]*data-attachment-key="([^"]+)"[^>]*>', "\n> [embedded image, attachment $1]\n")
    t = F.regexp_replace(t, r"<img[^>]*>", "")
    t = F.regexp_replace(t, r'(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', "[$2]($1)")
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?is)<h{level}[^>]*>\s*(.*?)\s*</h{level}>", "\n" + "#" * level + " $1\n")
    t = F.regexp_replace(t, r"(?is)<(strong|b)[^>]*>(.*?)</\1>", "**$2**")
    t = F.regexp_replace(t, r"(?is)<(em|i)[^>]*>(.*?)</\1>", "*$2*")
    t = F.regexp_replace(t, r"(?is)<code[^>]*>(.*?)</code>", "`$1`")
    t = F.regexp_replace(t, r"(?is)<li[^>]*>(.*?)</li>", "\n- $1")
    t = F.regexp_replace(t, r"(?i)</?(ul|ol)[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</p>", "\n\n")
    t = F.regexp_replace(t, r"(?i)<p[^>]*>", "\n")
    t = unescape(F.regexp_replace(t, r"<[^>]+>", ""))
    t = strip_cjk_spacing(F.regexp_replace(t, r"[ \t ]+", " "))
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def embedded_images(raw: Column) -> Column:
    return regex_count(raw, "data-attachment-key")


#: Bits of a character's kind. A character beyond ASCII is worked on as one byte: BEYOND and its kind.
LETTER, WORD, WHITE, HAN, FOREIGN, DOTTED, BEYOND = 1, 2, 4, 8, 16, 32, 128
#: Texts are counted in slices of about so many characters.
SLICE_CHARS = 1 << 18


def _kind(c: str) -> int:
    """Words consist of letters, numbers and ``_``; a dotted capital I is an i when lowered."""
    word = c == "_" or unicodedata.category(c)[0] in "LN"
    return LETTER * bool(re.match("[A-Za-z]", c)) | WORD * word | WHITE * c.isspace() | HAN * bool(re.match(f"[{CJK}]", c)) | FOREIGN * bool(re.match(f"[{EXOTIC}]", c)) | DOTTED * (c == "\u0130")


KINDS = np.array([_kind(chr(o)) if o < BEYOND else o - BEYOND for o in range(256)], dtype=np.uint8)
LOWERED = np.array([ord(chr(o).lower()) if o < BEYOND else ord("i") if o & DOTTED else o for o in range(256)], dtype=np.uint8)
#: Common words as numbers of eight bytes, and what of such a number belongs to a word of a length.
COMMON_NUMBERS = np.sort(np.array([int.from_bytes(w.encode(), "little") for w in COMMON_WORDS], dtype=np.uint64))
COMMON_LENGTHS = (min(map(len, COMMON_WORDS)), max(map(len, COMMON_WORDS)))
LENGTH_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Of kinds, as they are numbered: which count as total, cjk, latin, exotic.
COUNTED = np.array([[not k & WHITE, bool(k & HAN), bool(k & LETTER), bool(k & FOREIGN)] for k in range(2 * DOTTED)], dtype=np.int64)


def _codes(text: str, known: np.ndarray) -> np.ndarray:
    """One byte a character; ``known`` keeps the bytes of those beyond ASCII, by code point."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), dtype=np.uint8)
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    codes = points.astype(np.uint8)
    beyond = np.flatnonzero(points >= BEYOND)
    for o in np.unique(points[beyond[known[points[beyond]] == 0]]):
        known[o] = BEYOND | _kind(chr(o))
    codes[beyond] = known[points[beyond]]
    return codes


def _known() -> np.ndarray:
    return np.zeros(sys.maxunicode + 1, dtype=np.uint8)


def _word_places(codes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where Latin words and where common words begin, among codes that begin with a space and end with eight."""
    letter, word = (kinds & LETTER) != 0, (kinds & WORD) != 0
    latin = np.flatnonzero(letter[1:-1] & ~letter[:-2] & letter[2:]) + 1
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1  # words begin and end in turns
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    short = (lengths >= COMMON_LENGTHS[0]) & (lengths <= COMMON_LENGTHS[1])
    starts, lengths = starts[short], lengths[short]
    values = LOWERED[np.lib.stride_tricks.sliding_window_view(codes, 8)[starts]].view("<u8").ravel() & LENGTH_MASKS[lengths]
    return latin, starts[COMMON_NUMBERS[np.minimum(np.searchsorted(COMMON_NUMBERS, values), len(COMMON_NUMBERS) - 1)] == values]


def _strings(rows: pa.Array) -> Iterator[str]:
    """One at a time; null is empty, bytes that are no UTF-8 become U+FFFD, as in the JVM."""
    return ((x.as_py() or b"").decode("utf-8", "replace") for x in rows.cast(pa.large_binary()))


def _pieces(rows: pa.Array) -> Iterator[tuple[int, str]]:
    """(number of the text, piece): texts whole, or cut between words where they are longer than a slice."""
    gap = re.compile(r"\W")
    for i, text in enumerate(_strings(rows)):
        at = 0
        while len(text) - at > SLICE_CHARS and (cut := gap.search(text, at + SLICE_CHARS)):
            yield i, text[at:cut.start()]
            at = cut.start()
        yield i, text[at:] if at else text


def _slices(rows: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    numbers, pieces, size = [], [], 0
    for i, piece in _pieces(rows):
        numbers.append(i)
        pieces.append(piece)
        size += len(piece) + 1
        if size >= SLICE_CHARS:
            yield numbers, pieces
            numbers, pieces, size = [], [], 0
    if pieces:
        yield numbers, pieces


COUNTS = ("total", "cjk", "latin", "exotic", "words", "common")


def count_texts(rows: pa.Array, known: np.ndarray) -> np.ndarray:
    """COUNTS of each text, a row each."""
    out = np.zeros((len(rows), len(COUNTS)), dtype=np.int64)
    for numbers, pieces in _slices(rows):
        codes = _codes(" " + " ".join(pieces) + " " * 8, known)
        kinds = KINDS[codes]
        bounds = np.cumsum([1, *(len(p) + 1 for p in pieces)])
        chars = np.array([np.bincount(kinds[a:b], minlength=len(COUNTED)) for a, b in zip(bounds, bounds[1:])]) @ COUNTED
        words = [np.diff(np.searchsorted(places, bounds)) for places in _word_places(codes, kinds)]
        np.add.at(out, numbers, np.column_stack([chars, *words]))
    return out


def text_counts(text: Column, once: bool = False) -> Column:
    """Struct of COUNTS: characters that aren't white space, CJK, Latin and exotic ones, Latin words of two letters or
    more, common English words. One pass over a text; regular expressions would build every match.

    ``once``: counted where it stands in the plan; a filter on the counts doesn't take them ahead of a shuffle that deals texts out.
    """

    @F.arrow_udf(", ".join(f"{n} int" for n in COUNTS))
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _known()
        for rows in texts:
            yield pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in count_texts(rows, known).T], COUNTS)

    return (run.asNondeterministic() if once else run)(text)


def char_stats(text: Column) -> dict[str, Column]:
    """Counts of CJK, Latin and exotic characters among those that aren't white space, and their shares."""
    counts = text_counts(text)
    return {n: counts[n] for n in ("total", "cjk", "latin", "exotic")} | _shares(counts)


def _shares(counts: Column) -> dict[str, Column]:
    return {f"{n}_ratio": F.when(counts["total"] > 0, counts[n] / counts["total"]).otherwise(F.lit(0.0)) for n in ("exotic", "cjk", "latin")}


def with_char_stats(df: DataFrame, text: str = "text", words: bool = False) -> DataFrame:
    """Add ``total``, ``cjk``, ``latin``, ``exotic`` and their shares, each text counted once for what uses them; on demand ``__words``
    (Latin words) and ``__common`` (share of common ones) too."""
    counts = F.col("__counts")
    added = {n: counts[n] for n in ("total", "cjk", "latin", "exotic")} | _shares(counts) | ({"__words": counts["words"], "__common": _common_share(counts)} if words else {})
    return df.withColumn("__counts", text_counts(F.col(text), once=True)).withColumns(added).drop("__counts")


def text_verdict(s: dict[str, Column]) -> Column:
    """ok, bad or unsure, from character counts and shares, by rules in order."""
    return (
        F.when(s["total"] < 100, "bad").when(s["exotic_ratio"] > 0.10, "bad").when(s["latin_ratio"] > 0.80, "ok").when(s["cjk_ratio"] < 0.005, "bad")
        .when(s["exotic_ratio"] > 0.01, "unsure").when(s["cjk_ratio"] < 0.05, "unsure").otherwise("ok")
    )


def latin_words(text: Column) -> Column:
    return text_counts(text)["words"]


def common_word_ratio(text: Column) -> Column:
    """Share of common English words among Latin words; 0 without any."""
    return _common_share(text_counts(text))


def _common_share(counts: Column) -> Column:
    return F.when(counts["words"] > 0, counts["common"] / counts["words"]).otherwise(F.lit(0.0))


SHIFT_SPAN, SHIFT_SAMPLE = 40, 6000


def deshift(text: Column, shift: int) -> Column:
    """Move every printable ASCII character but the space by ``shift``; those that would leave the range stay."""
    return F.translate(text, *_shift_map(shift)) if shift else text


def _shift_map(shift: int) -> tuple[str, str]:
    pairs = [(chr(o), chr(o + shift)) for o in range(0x21, 0x7F) if 0x21 <= o + shift <= 0x7E]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


SHIFTS = [n for n in range(-SHIFT_SPAN, SHIFT_SPAN + 1) if n]
#: Texts that are tried at once.
SHIFT_TEXTS = 8


def _bits(flags: np.ndarray) -> np.ndarray:
    """(shift, code) flags as a row of 128 bits a code, one a shift."""
    return np.ascontiguousarray(np.packbits(np.pad(flags, ((0, 128 - len(SHIFTS)), (0, 0))), axis=0, bitorder="little").T).view(np.uint64)


def _shifted_codes() -> np.ndarray:
    tables = np.tile(np.arange(256, dtype=np.uint8), (len(SHIFTS), 1))
    for row, shift in zip(tables, SHIFTS):
        a, b = _shift_map(shift)
        row[list(a.encode())] = list(b.encode())
    return tables


#: By code, the shifts in which it belongs to Latin words, to words, or reads as a letter of a common word.
SHIFTED = _shifted_codes()
LETTER_BITS, WORD_BITS = (_bits(KINDS[SHIFTED] & kind != 0) for kind in (LETTER, WORD))
READS_BITS = {c: _bits(LOWERED[SHIFTED] == ord(c)) for c in sorted(set("".join(COMMON_WORDS)))}
#: The first two letters of common words, and by two codes in a row those that they can read as in any one shift, a bit each.
BEGINNINGS = sorted({w[:2] for w in COMMON_WORDS})
BEGINNING_BITS = sum((((READS_BITS[x][:, None] & READS_BITS[y]) != 0).any(axis=2).astype(np.uint64) << np.uint64(k) for k, (x, y) in enumerate(BEGINNINGS)), np.zeros((256, 256), dtype=np.uint64))


def _bit_sums(rows: np.ndarray) -> np.ndarray:
    """How many rows of 128 bits have each shift's bit."""
    columns, ones = np.ascontiguousarray(rows.T), np.uint64(0x0101010101010101)
    if not len(rows):
        return np.zeros(len(SHIFTS), dtype=np.int64)
    # every eighth bit is a byte, so eight of them are added at once, 255 rows at most
    sums = [np.add.reduceat((columns >> np.uint64(k)) & ones, np.arange(0, len(rows), 255), axis=1).view(np.uint8).reshape(2, -1, 8).sum(axis=1, dtype=np.int64) for k in range(8)]
    return np.stack(sums, axis=-1).ravel()[:len(SHIFTS)]


def shift_ratios(texts: list[str], known: np.ndarray) -> Iterator[np.ndarray]:
    """For each text the share of common words among Latin ones, by shift of SHIFTS.

    All shifts are tried at once: what holds of a character is a bit for each shift, and words are found by what holds of
    characters in a row.
    """
    codes = _codes(" " + " ".join(texts) + " " * 8, known)
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    letter = LETTER_BITS.take(codes, axis=0)
    begins = letter[1:-1] & ~letter[:-2] & letter[2:]  # of the place after
    pairs = BEGINNING_BITS.ravel()[(codes[:-1].astype(np.uint16) << 8) | codes[1:]]
    likely = np.flatnonzero(pairs)
    pairs = pairs[likely]
    places, found = [], []
    for k, beginning in enumerate(BEGINNINGS):
        at = likely[np.flatnonzero(pairs & np.uint64(1 << k))]
        start = ~WORD_BITS.take(codes[at - 1], axis=0) & READS_BITS[beginning[0]].take(codes[at], axis=0) & READS_BITS[beginning[1]].take(codes[at + 1], axis=0)
        some = np.flatnonzero(start[:, 0] | start[:, 1])
        at, start = at[some], start.take(some, axis=0)
        for word in (w for w in COMMON_WORDS if w.startswith(beginning)):
            hit = start & ~WORD_BITS.take(codes[at + len(word)], axis=0)
            for i, c in enumerate(word[2:], 2):
                hit &= READS_BITS[c].take(codes[at + i], axis=0)
            some = np.flatnonzero(hit[:, 0] | hit[:, 1])
            places.append(at[some])
            found.append(hit.take(some, axis=0))
    places, found = np.concatenate(places), np.concatenate(found)
    for a, b in zip(bounds, bounds[1:]):
        n, hits = _bit_sums(begins[a - 1:b - 1]), _bit_sums(found[(places >= a) & (places < b)])
        yield np.where(n > 0, hits / np.maximum(n, 1), 0.0)


def best_shift(text: Column) -> Column:
    """Struct (shift, ratio): the shift within SHIFT_SPAN with the most common words in the first SHIFT_SAMPLE characters.

    80 trials a text are too many for one expression, so they run as vectorised Python; only
    suspects need it: a null text is shift 0. Ties go to the shift tried first.
    """

    @F.arrow_udf("shift int, ratio double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _known()
        for rows in texts:
            full = np.flatnonzero(rows.is_valid().to_numpy(zero_copy_only=False))
            suspects, shift, ratio = rows.take(pa.array(full)), np.zeros(len(rows), dtype=np.int32), np.zeros(len(rows))
            for at in range(0, len(full), SHIFT_TEXTS):
                for i, r in zip(full[at:], shift_ratios(list(_strings(suspects.slice(at, SHIFT_TEXTS))), known)):
                    shift[i], ratio[i] = (SHIFTS[r.argmax()], r.max()) if r.any() else (0, 0.0)
            yield pa.StructArray.from_arrays([pa.array(shift), pa.array(ratio)], ["shift", "ratio"])

    return run(F.substring(text, 1, SHIFT_SAMPLE))


def shift_accepted(before: Column, words: Column, latin_ratio: Column, after: Column) -> Column:
    return (latin_ratio >= 0.5) & (words >= 200) & (before < 0.12) & (after >= 0.15) & (after - before >= 0.10)


def heading_level(title: Column) -> Column:
    """第N章/节 and one number: 1; 1.2: 2; deeper: 3; no number: 0 (inherits)."""
    t = strip(title)
    number = F.regexp_extract(t, r"(?U)^(\d+(?:\.\d+)*)(?=\s|[.、,，:：)）(（]|$)", 1)
    return (
        F.when(t.rlike(r"(?U)^第\s*[0-9一二三四五六七八九十百]+\s*[章节]"), 1)
        .when(number == "", 0).otherwise(F.least(F.lit(3), F.size(F.split(number, r"\."))))
    )


def section_kind(title: Column, inherited: Column | None = None) -> Column:
    out = None
    for pattern, kind in SECTION_RULES:
        hit = _text(title).rlike(pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(F.coalesce(F.nullif(inherited, F.lit("")), F.lit("body")) if inherited is not None else F.lit("body"))


def indexable(level: Column, kind: Column) -> Column:
    return (level == 1) & ~F.coalesce(kind, F.lit("")).isin(*UNINDEXED_KINDS)


NUMBER_LIST = r"\d+(?:\s*[-–—,，、]\s*\d+)*"


def drop_citation_sups(text: Column) -> Column:
    """Superscript citations, unless a Latin letter, a digit or ``>`` stands before them (units, powers)."""
    inner = rf"\s*(?:{NUMBER_LIST}|\[{NUMBER_LIST}\]|［{NUMBER_LIST}］)\s*"
    return F.regexp_replace(_text(text), rf"(?is)(?<![A-Za-z0-9>])<sup>{inner}</sup>", "")


def drop_citation_numbers(text: Column) -> Column:
    """[n], [n-m] and [n,m], but not link labels, nor inside $$…$$ or a kept <sup>…</sup>.

    The text is taken apart into protected and free pieces; only free ones are rewritten.
    """
    protected = r"(?s)\$\$.*?\$\$|(?i:<sup>).*?(?i:</sup>)"
    pieces = F.regexp_extract_all(_text(text), F.lit(rf"(?s)(?:{protected[4:]})|(?:(?!\$\$.*?\$\$|(?i:<sup>).*?(?i:</sup>)).)+"), F.lit(0))
    free = lambda x: F.regexp_replace(F.regexp_replace(x, rf"\[{NUMBER_LIST}\](?!\()", ""), rf"［{NUMBER_LIST}］", "")
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(rf"^(?:{protected})$"), x).otherwise(free(x))), "")


def drop_copyright_lines(text: Column) -> Column:
    t = _text(text)
    kept = F.array_join(F.filter(F.split(t, "\n"), lambda x: ~x.rlike(COPYRIGHT_LINE)), "\n")
    return F.when(t.contains("http") | t.contains("\n"), kept).otherwise(t)


def clean_for_index(text: Column) -> Column:
    """The form of a text that is cut and embedded; never stored. Applying it twice changes nothing more."""
    return drop_copyright_lines(drop_citation_numbers(drop_citation_sups(text)))


def split_sentences(text: Column) -> Column:
    """Sentences, cut after a final mark; CJK ones need no space after it."""
    return F.filter(F.transform(F.split(_text(text), r"(?<=[。！？；.!?;])\s*"), lambda x: strip(x)), lambda x: x != "")


def join_sentences(left: Column, right: Column) -> Column:
    tight = F.substring(left, -1, 1).isin(*"。！？；、，）】》")
    return F.when(_text(left) == "", right).when(_text(right) == "", left).otherwise(F.concat(left, F.when(tight, "").otherwise(" "), right))


def edge_form(line: Column) -> Column:
    """A header or footer line without its numbers: digits to #, spaces collapsed, lowered."""
    return F.lower(strip(F.regexp_replace(F.regexp_replace(_text(line), r"(?U)\d+", "#"), SPACE, " ")))


def normalize_query(text: Column) -> Column:
    """Full-width characters to half-width, white space collapsed."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
    return strip(F.regexp_replace(F.translate(_text(text), wide, narrow), SPACE, " "))


def snippet(text: Column, words: Column, width: int = 220) -> Column:
    """A window around the earliest of the words, starting a third of it before; white space collapsed."""
    places = F.filter(F.transform(words, lambda w: F.call_function("instr", text, w)), lambda p: p > 0)
    best = F.coalesce(F.array_min(places), F.lit(0)) - 1
    start = F.when(best < 0, 0).otherwise(F.greatest(F.lit(0), best - width // 3))
    body = strip(F.regexp_replace(F.call_function("substring", text, start + 1, F.lit(width)), SPACE, " "))
    return F.concat(F.when(best > width // 3, "…").otherwise(""), body, F.lit("…"))


def segments_cjk(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(f"[{CJK_WIDE}]+"), F.lit(0))


def coverage_units(text: Column) -> Column:
    """array<struct<unit, weight>>: CJK 1- to 4-grams and lowered Latin words, weight length squared."""
    grams = F.flatten(F.transform(segments_cjk(text), lambda s: F.flatten(F.transform(
        F.sequence(F.lit(1), F.least(F.lit(4), F.length(s))),
        lambda n: F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.call_function("substring", s, i, n))))))
    words = F.transform(F.regexp_extract_all(normalize_query(text), F.lit(r"[A-Za-z][A-Za-z0-9_\-]{0,30}"), F.lit(0)), lambda w: F.lower(w))
    units = F.array_distinct(F.concat(grams, words))
    return F.transform(units, lambda u: F.struct(u.alias("unit"), (F.length(u) * F.length(u)).cast("double").alias("weight")))


def index_terms(text: Column) -> Column:
    """Distinct terms of a chunk: single CJK characters and lowered Latin words of 2 to 31 characters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_text(text), F.lit(rf"[{CJK}]|[A-Za-z][A-Za-z0-9_\-]{{1,30}}"), F.lit(0)), lambda w: F.lower(w)))


def parse_extra(text: Column) -> Column:
    """``KEY: value`` lines to a map; the first of a repeated key stays, full-width colons count."""
    line = r"^\s*([A-Za-z][A-Za-z0-9 ._\-]{0,30}?)\s*[:：]\s*(.*?)\s*$"
    rows = F.filter(F.split(_text(text), r"\r?\n"), lambda x: x.rlike(line))
    keys = F.transform(rows, lambda x: F.regexp_extract(x, line, 1))
    firsts = F.filter(F.transform(rows, lambda x, i: F.struct(F.regexp_extract(x, line, 1).alias("k"), F.regexp_extract(x, line, 2).alias("v"), i.alias("i"))), lambda s: F.array_position(keys, s["k"]) == s["i"] + 1)
    return F.map_from_entries(F.transform(firsts, lambda s: F.struct(s["k"], s["v"])))


def unparsed_extra(text: Column) -> Column:
    line = r"^\s*([A-Za-z][A-Za-z0-9 ._\-]{0,30}?)\s*[:：]\s*(.*?)\s*$"
    return F.array_join(F.filter(F.split(_text(text), r"\r?\n"), lambda x: ~x.rlike(line) & (strip(x) != "")), "\n")


def strip_jats(text: Column) -> Column:
    t = F.regexp_replace(_text(text), r"<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return strip(F.regexp_replace(t, SPACE, " "))


def clip_sentence(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut after a sentence that ends beyond 60 % of them, else with an ellipsis."""
    head = F.substring(text, 1, limit)
    body = F.regexp_extract(head, r"(?s)^(.*[。！？.!?])", 1)
    return F.when(F.length(text) <= limit, text).when(F.length(body) > int(limit * 0.6), body).otherwise(F.concat(F.rtrim(head), F.lit("…")))


def even_sample(text: Column, parts: int = 4, size: int = 500) -> Column:
    """``parts`` pieces of ``size`` characters at equal steps; a shorter text whole."""
    n = F.length(text)
    step = F.floor((n - size) / (parts - 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.call_function("substring", text, i * step + 1, F.lit(size)))
    return F.when(n <= parts * size, F.array(text)).otherwise(pieces)

