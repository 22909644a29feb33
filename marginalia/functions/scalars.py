"""Scalar rules: years, weights, identifiers, names and hashes, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the ranking weights.
RECENCY_HIGH, RECENCY_LOW, RECENCY_YEARS = 1.05, 0.95, 15
PINNED, EFFECTIVE, INEFFECTIVE, PARTIAL = 3.0, 2.0, 0.5, 1.0
HEALTH_PENALTY = 0.25
DOC_FIELDS = ("title", "year", "doi", "venue", "abstract")


def number_prefix(text: Column) -> Column:
    """The numeric beginning of a text as a number, 0 without one: what an untyped store's CAST gives."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([+-]?\d{1,18})", 1)
    return F.coalesce(F.nullif(head, F.lit("")).cast("long"), F.lit(0).cast("long"))


def year_number(year: Column) -> Column:
    """The whole text as an integer, 0 if it isn't one."""
    return F.coalesce(F.when(F.trim(year).rlike(r"^[+-]?\d{1,9}$"), F.trim(year)).cast("int"), F.lit(0))


def year_filter(year: Column, year_from: int | None = None, year_to: int | None = None) -> Column:
    """A year that can't be read fails ``year_from`` and passes ``year_to`` alone."""
    y, keep = year_number(year), F.lit(True)
    if year_from is not None:
        keep = keep & (y >= year_from)
    if year_to is not None:
        keep = keep & (y <= year_to)
    return keep


def recency_base(year: Column, now_year: int) -> Column:
    """1.05 for this year or later, 0.95 from 15 years on, linear between; 1.0 for what is no year."""
    head = F.substring(F.trim(F.coalesce(year.cast("string"), F.lit(""))), 1, 4)
    y = F.when(head.rlike(r"^[+-]?\d+$"), head).cast("int")
    age = F.lit(now_year) - y
    middle = F.bround(F.lit(RECENCY_HIGH) + F.lit(RECENCY_LOW - RECENCY_HIGH) * (age / RECENCY_YEARS), 6)
    return F.when(y.isNull() | (y < 1800) | (y > 2200), 1.0).when(age <= 0, RECENCY_HIGH).when(age >= RECENCY_YEARS, RECENCY_LOW).otherwise(middle)


def _n(col: Column) -> Column:
    return F.coalesce(col.cast("double"), F.lit(0.0))


def raw_weight(base: Column, pinned: Column, manual: Column, effective: Column, ineffective: Column, partial: Column) -> Column:
    return base + PINNED * _n(pinned) + _n(manual) + EFFECTIVE * _n(effective) + INEFFECTIVE * _n(ineffective) + PARTIAL * _n(partial)


def weight_multiplier(raw: Column, bad_health: Column | None = None) -> Column:
    """1 + ln(raw), 0 where raw is not positive; a quarter of it for unreadable text."""
    m = F.when(raw > 0, 1 + F.log(raw)).otherwise(F.lit(0.0))
    return m * F.when(F.coalesce(bad_health, F.lit(False)), HEALTH_PENALTY).otherwise(1.0) if bad_health is not None else m


def board_score(pinned: Column, manual: Column, effective: Column, ineffective: Column) -> Column:
    """The weight board's order: linear, without partial results."""
    return PINNED * _n(pinned) + _n(manual) + EFFECTIVE * _n(effective) + INEFFECTIVE * _n(ineffective)


def cli_score(pinned: Column, manual: Column, effective: Column, ineffective: Column) -> Column:
    """The command line's order, where an ineffective trial counts whole."""
    return PINNED * _n(pinned) + _n(manual) + EFFECTIVE * _n(effective) + _n(ineffective)


def normalize_doi(doi: Column) -> Column:
    """A DOI without resolver, scheme and final marks, lowered; empty if it isn't one."""
    d = F.lower(F.trim(F.coalesce(doi, F.lit(""))))
    d = F.regexp_replace(d, r"^(?:https?://)?(?:dx\.)?doi\.org/", "")
    d = F.regexp_replace(F.regexp_replace(d, r"^doi\s*[:：]?\s*", ""), r"[\s.,;，。；)\]]+$", "")
    return F.when(d.rlike(r"^10\.\d{4,9}/\S+$"), d).otherwise("")


def human_size(n: Column) -> Column:
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for i, unit in enumerate(units[1:], 1):
        text = F.concat(F.format_string("%.1f", n / float(1024**i)), F.lit(f" {unit}"))
        out = out.when(n < 1024.0 ** (i + 1), text) if i < len(units) - 1 else out.otherwise(text)
    return out


def sha1_prefix(text: Column, n: int) -> Column:
    return F.substring(F.sha1(F.coalesce(text, F.lit(""))), 1, n)


def collections_signature(keys: Column, tags: Column) -> Column:
    """Order-free fingerprint of an item's collections and tags."""
    side = lambda xs: F.array_join(F.array_sort(F.coalesce(xs, F.array().cast("array<string>"))), "\x1f")
    return sha1_prefix(F.concat(side(keys), F.lit("\x1e"), side(tags)), 16)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once and standing once in the plan, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that later filters and columns read: as a generator's output it is never written out again where they stand."""
    return df.select("*", F.explode(F.array(value)).alias(name))


NO_TITLE = "(无标题)"


def clean_name(text: Column) -> Column:
    """A name fit for tables and files: without the signs that file systems refuse, white space as single spaces, no blanks or dots at its ends."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), r"""[<>:"/\\|?*\x00-\x1f]""", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), r"^[ .]+|[ .]+$", "")


def short_title(title: Column, limit: int = 40) -> Column:
    """A clean title without its subtitle, at most ``limit`` characters and an ellipsis; Latin text is cut between words where one ends near the limit.

    A subtitle begins at a full-width colon or a long dash that has six characters or more before it. A blank title gives a mark.
    """
    head = lambda t, sep: F.trim(F.get(F.split(t, sep, 2), F.lit(0)))
    main = lambda t: F.when(t.contains("：") & (F.length(head(t, "：")) >= 6), head(t, "：")).when(t.contains("——") & (F.length(head(t, "——")) >= 6), head(t, "——")).otherwise(t)
    word = F.lit(max(6, limit - 16))
    space = lambda c: F.length(c) - F.length(F.regexp_extract(c, " ([^ ]*)$", 0))
    cut = lambda c: F.when(c.rlike("[A-Za-z]") & c.contains(" ") & (space(c) >= word), F.call_function("substring", c, F.lit(1), space(c))).otherwise(c)
    shown = lambda t: F.when(t == "", NO_TITLE).when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(let(F.substring(t, 1, limit), cut), "[ ,，、;；]+$", ""), F.lit("…")))
    return let(let(clean_name(title), main), shown)


def short_author(name: Column) -> Column:
    """A Western name as last name and initials; CJK names and single words as they are. A first word of at most three letters is
    taken for the last name, else the final word is."""

    def shorten(parts: Column) -> Column:
        short = F.length(F.regexp_replace(F.get(parts, F.lit(0)), r"\.+$", "")) <= 3
        family = F.when(short, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.size(parts) - 1))
        given = F.when(short, F.slice(parts, F.lit(2), F.size(parts) - 1)).otherwise(F.slice(parts, F.lit(1), F.size(parts) - 1))
        return F.concat_ws(" ", family, F.array_join(F.transform(given, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), ""))

    return let(clean_name(name), lambda a: F.when(a.rlike("[一-鿿]") | ~a.contains(" "), a).otherwise(let(F.split(a, " "), shorten)))


def western_short(last: Column, first: Column) -> Column:
    """Last name and initials of an author of two fields; one that is all last name as it is."""
    last, first = F.coalesce(last, F.lit("")), F.coalesce(first, F.lit(""))
    parts = F.filter(F.split(F.replace(first, F.lit("."), F.lit(" ")), r"(?U)\s+"), lambda p: p != "")
    initials = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), "")
    return F.when((last != "") & (first == ""), last).otherwise(F.trim(F.concat_ws(" ", last, initials)))


def human_ref(title: Column, first_author: Column, year: Column, limit: int = 40) -> Column:
    """``Author Year · short title``, for show; parts that are missing are left out."""
    head = F.concat_ws(" ", F.nullif(short_author(first_author), F.lit("")), F.nullif(F.trim(F.coalesce(year.cast("string"), F.lit(""))), F.lit("")))
    return F.concat_ws(" · ", F.nullif(head, F.lit("")), short_title(title, limit))


def human_label(title: Column, first_author: Column, year: Column, key: Column, limit: int = 40) -> Column:
    """The same with the key that tells equal ones apart."""
    return F.concat_ws("  ", human_ref(title, first_author, year, limit), F.when(F.coalesce(key, F.lit("")) != "", F.concat(F.lit("["), key, F.lit("]"))))


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields that are null or blank."""
    return F.array_compact(F.array(*[F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(n)) for n, c in fields.items()]))


def article_pages(number: Column) -> Column:
    """``(2024)03-0296-05`` to struct(year, issue, pages): five pages from 296 are 296-300."""
    pattern = r"[（(](\d{4})[)）](\d{2})-(\d{3,4})-(\d{2})"
    part = lambda i: F.when(number.rlike(pattern), F.regexp_extract(number, pattern, i)).cast("int")
    first, count = part(3), part(4)
    return F.struct(part(1).alias("year"), part(2).alias("issue"), F.when(count > 0, F.concat(first.cast("string"), F.lit("-"), (first + count - 1).cast("string"))).alias("pages"))


def partial_date(text: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD from ISO, slashed, dotted or CJK dates; null if there is none."""
    pattern = r"((?:19|20)\d{2})(?:\s*[-/.年]\s*(\d{1,2})(?:\s*[-/.月]\s*(\d{1,2}))?)?"
    y, m, d = (F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, i), F.lit("")) for i in (1, 2, 3))
    month, day = F.lpad(m, 2, "0"), F.lpad(d, 2, "0")
    good_m = m.cast("int").between(1, 12)
    good_d = d.cast("int").between(1, 31)
    return F.when(good_m & good_d, F.concat_ws("-", y, month, day)).when(good_m, F.concat_ws("-", y, month)).otherwise(y)


#: Words that belong to a last name, and endings of a name.
NAME_PARTICLES = "van von der den de del della di da dos la le bin ibn ter ten st".split()
NAME_SUFFIX = r"(?i)(?:^|\s)(?:jr|sr|ii|iii|iv)\.?$"


def split_name(name: Column) -> Column:
    """struct(last, first). A name is split only where that is safe, else it is the last name as a whole.

    ``Last, First`` is split at its comma; a name of two or three words at its one word in capitals, which is the
    last name, or else before its final word. Names with a CJK character, a suffix, a hyphen or a particle
    stay whole, and so do single words, four words or more and several words in capitals.
    """
    bare = lambda w: F.regexp_replace(w, r"\.+$", "")
    named = lambda last, first: F.struct(last.alias("last"), first.alias("first"))

    def by_words(n: Column, words: Column, caps: Column) -> Column:
        particle = F.exists(words, lambda w: F.lower(bare(w)).isin(NAME_PARTICLES))
        cut = F.split(n, ",", 2)
        before, after = F.trim(F.get(cut, F.lit(0))), F.trim(F.get(cut, F.lit(1)))
        whole, one = named(n, F.lit("")), F.get(caps, F.lit(0))
        return (
            F.when(n.rlike(r"[一-鿿]") | n.rlike(NAME_SUFFIX) | n.rlike("[-\u2010\u2011]") | particle, whole)
            .when(n.contains(","), F.when((before != "") & (after != ""), named(before, after)).otherwise(whole))
            .when((F.size(words) < 2) | (F.size(caps) >= 2), whole)
            .when(F.size(caps) == 1, named(one, F.array_join(F.filter(words, lambda w: w != one), " ")))
            .when(F.size(words) >= 4, whole)
            .otherwise(named(F.get(words, F.size(words) - 1), F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")))
        )

    capitals = lambda words: F.filter(words, lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(bare(w)) >= 2))
    split = lambda n: let(F.filter(F.split(n, r"\s+"), lambda w: w != ""), lambda words: let(capitals(words), lambda caps: by_words(n, words, caps)))
    return let(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", "")), split)


#: Site names at the end of a title, with how sure they are, the surest first.
TITLE_TAILS = (
    (r"\s*\|\s*IEEE\s+Journals?\s*&\s*Magazine\s*\|\s*IEEE\s+Xplore\s*$", "high"),
    (r"\s*\|\s*IEEE\s+Conference\s+Publication\s*\|\s*IEEE\s+Xplore\s*$", "high"),
    (r"\s*\|\s*IEEE\s+Xplore\s*$", "high"),
    (r"\s*\|\s*IEEE\s+Access\s*$", "high"),
    (r"\s*[-–—|]\s*ScienceDirect\.com\s*$", "high"),
    (r"\s*\|\s*SpringerLink\s*$", "high"),
    (r"\s*\|\s*Wiley\s+Online\s+Library\s*$", "high"),
    (r"\s*[-–—_|]\s*[\u4e00-\u9fffA-Za-z0-9]{2,12}(?:网|网站|官网|首页|资讯|新闻网)\s*$", "low"),
)


def title_tail(title: Column) -> Column:
    """struct(value, confidence): a title without the site name at its end, null where it has none.

    What is left must have some weight: 8 where the name is sure, 12 where it isn't, and then half of the title too.
    """
    t = F.trim(F.coalesce(title, F.lit("")))
    found = None
    for pattern, confidence in TITLE_TAILS:
        left = F.regexp_replace(F.regexp_replace(t, pattern, ""), r"^[ \t\-–—|·]+|[ \t\-–—|·]+$", "")
        good = t.rlike(pattern) & (title_weight(left) >= (8 if confidence == "high" else 12))
        if confidence == "low":
            good = good & (F.length(t) - F.length(left) <= F.length(t) * 0.5)
        made = F.struct(left.alias("value"), F.lit(confidence).alias("confidence"))
        found = F.when(good, made) if found is None else found.when(good, made)
    return found


def clean_title(title: Column) -> Column:
    """A title without the site name at its end, if it has one."""
    return F.coalesce(title_tail(title)["value"], F.trim(F.coalesce(title, F.lit(""))))


def title_weight(title: Column) -> Column:
    """Display width: a CJK character counts two."""
    t = F.coalesce(title, F.lit(""))
    return F.length(t) + F.regexp_count(t, F.lit("[一-鿿]"))


def plain_title(title: Column) -> Column:
    """For comparison: letters and digits only, lowered."""
    return F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def recover_json(text: Column) -> Column:
    """The JSON object in a model's answer: without fences, from the first { to the last }; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1), F.lit(""))
