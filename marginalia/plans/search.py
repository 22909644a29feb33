"""The ranked query: recall, fuse, dedup, aggregate, filter, weight, limit, in that order."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import text as tx
from marginalia.operators import retrieval as rt
from marginalia.operators.relational import kept


@dataclass(frozen=True)
class Index:
    """posts: see retrieval.postings; size: see retrieval.corpus_size; term_df: known terms, if they are kept."""

    posts: DataFrame
    size: tuple[int, float]
    term_df: DataFrame | None = None


@dataclass(frozen=True)
class Search:
    query: str
    limit: int = 10
    whole_documents: bool = False
    use_keyword: bool = True
    use_vector: bool = True
    collection: str | None = None
    year_from: int | None = None
    year_to: int | None = None


SNIPPETS, CONTEXT_CHARS = 2, 1500
#: Full-width forms of printable ASCII and of the space.
HALF_WIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}
LATIN = re.compile(r"[A-Za-z][A-Za-z0-9_\-]{0,30}")
RUN = re.compile(f"[{tx.CJK_WIDE}]+")
#: A quoted phrase, a CJK character, or a word.
TOKEN = re.compile(rf'"([^"]*)"?|[\u201c\u201d]([^\u201d]*)\u201d?|([{tx.CJK_WIDE}])|((?:(?![{tx.CJK_WIDE}])[^\W_]|[-_.])(?:[^\W_]|[-_.])*)')
WORD = re.compile(r"[^\W_]+(?:_+[^\W_]+)*|_+")


def half_width(query: str | None) -> str:
    return " ".join((query or "").translate(HALF_WIDTH).split())


def tokenize(query: str | None) -> list[tuple[str, str]]:
    """A query's tokens, on the driver: (quoted, a phrase in quotes), (cjk, one character) or (word, a word)."""
    found = []
    for m in TOKEN.finditer(half_width(query)):
        phrase = m[1] if m[1] is not None else m[2]
        if phrase is not None:
            if phrase.strip():
                found.append(("quoted", phrase.strip()))
        else:
            found.append(("cjk", m[3]) if m[3] else ("word", m[4]))
    return found


def index_tokens(text: str) -> list[str]:
    """As postings() has them."""
    return re.findall(r"[^\W]+", RUN.sub(lambda m: " " + " ".join(m[0]) + " ", text.lower()))


def phrase_terms(query: str | None) -> list[list[str]]:
    """What the narrow recall looks for, any of it: each CJK run as a phrase, each Latin word."""
    q = half_width(query)
    found = [list(run) for run in RUN.findall(q)] + [index_tokens(w) for w in LATIN.findall(q)]
    return [p for k, p in enumerate(found) if p and p not in found[:k]]


def wide_terms(query: str | None) -> tuple[list[list[str]], list[list[int]]]:
    """What the wide recall looks for: phrases, and groups of them of which one must be there as a whole. A token
    is a group of its own; a quoted phrase is the group of its CJK characters, or without any one phrase."""
    phrases: list[list[str]] = []
    groups: list[list[int]] = []

    def number(tokens: list[str]) -> int:
        if tokens not in phrases:
            phrases.append(tokens)
        return phrases.index(tokens)

    for kind, text in tokenize(query):
        own = [[c] for c in text if RUN.match(c)] if kind == "quoted" else []
        group = [number(p) for p in own or [index_tokens(text)] if p]
        if group and group not in groups:
            groups.append(group)
    return phrases, groups


def parse_units(query: str | None) -> list[tuple[str, float]]:
    """The query's units, on the driver: one short string. Weight is the length squared; heaviest first."""
    q = half_width(query)
    units = {w.lower() for w in LATIN.findall(q)}
    for run in RUN.findall(q):
        units |= {run[i : i + n] for n in range(1, 5) for i in range(len(run) - n + 1)}
    return sorted(((u, float(len(u) ** 2)) for u in units), key=lambda x: (-x[1], x[0]))


def any_known(units: list[tuple[str, float]], term_df: DataFrame | None) -> bool:
    """Whether the keyword route can find anything: a unit of two characters or more, or a known term."""
    if any(len(u) > 1 for u, _ in units):
        return True
    return bool(units) and (term_df is None or not term_df.where(F.col("term").isin([u for u, _ in units])).isEmpty())


def coverage_route(chunks: DataFrame, units: list[tuple[str, float]], key: str = "chunk_id", limit: int = rt.ROUTE_LIMIT) -> DataFrame:
    """(key, coverage, strong, rank, norm): the best chunks by coverage, of all. Each task keeps its best before they meet."""
    top = rt.coverage(chunks, units, key).orderBy(F.desc("coverage"), F.desc("strong"), key).limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("coverage"), F.desc("strong"), key)))
    return rt.normalized(ranked, "coverage")


def keyword_route(chunks: DataFrame, query: str, key: str = "chunk_id", limit: int = rt.ROUTE_LIMIT, index: Index | None = None) -> DataFrame | None:
    """(key, coverage, strong, bm25, rank, norm): chunks recalled by phrase, then ranked by coverage, strong and bm25.

    Phrases first, three times ``limit``; where fewer than five chunks hold one, six times ``limit`` by any token are added. None
    if nothing of the query can be known. Without a stored ``index`` one is made of ``chunks``.
    """
    units = parse_units(query)
    if not units or not any_known(units, index.term_df if index else None):
        return None
    narrow, (wide, groups) = phrase_terms(query), wide_terms(query)
    if index is None:
        # one pass over the texts counts all phrases; what follows reads its small result
        both = [*narrow, *[p for p in wide if p not in narrow]]
        counted = kept(rt.counted_in_texts(chunks, both, key))
        size = rt.size_of(counted)
        pick = lambda phrases: counted.select(key, "dl", *[F.col(f"tf{both.index(p)}").alias(f"tf{i}") for i, p in enumerate(phrases)])
        recall = lambda phrases, n, need=None: rt.recalled(pick(phrases), phrases, size, key, n, need)
    else:
        recall = lambda phrases, n, need=None: rt.phrase_recall(index.posts, phrases, index.size, key, n, need)
    found = kept(recall(narrow, 3 * limit))
    if wide and found.count() < rt.MIN_PHRASE_HITS:
        found = kept(found.union(recall(wide, 6 * limit, groups).join(found.select(key), key, "left_anti")))
    # at most nine times ``limit`` rows: a fixed bound
    covered = rt.coverage(chunks.join(F.broadcast(found.select(key)), key, "left_semi"), units, key).join(F.broadcast(found), key)
    best = [F.desc("coverage"), F.desc("strong"), F.desc("bm25"), F.col(key)]
    return rt.normalized(covered.orderBy(*best).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*best))), "coverage")


def vector_route(vectors: DataFrame, query: list[float], key: str = "chunk_id", limit: int = rt.ROUTE_LIMIT) -> DataFrame:
    return rt.normalized(rt.vector_topk(vectors, query, key, k=limit), "similarity")


def search(
    chunks: DataFrame, vectors: DataFrame | None, items: DataFrame, weights: DataFrame, ask: Search, query_vector: list[float] | None = None, keep: Column | None = None,
    index: Index | None = None, parents: DataFrame | None = None,
) -> DataFrame:
    """(item_key, score, base_score, weight, best_chunk, n_chunks, snippets, context, truncated), best first.

    chunks: chunk_id, item_key, parent_id, kind, text, and depth and level where there are any. items: item_key and
    whatever ``keep`` uses. weights: item_key, multiplier. parents: parent_id, text. Whole-document chunks (depth 2 and
    more) leave both routes before their limits unless asked for; hits at level 0 are not returned, their score goes to their
    item. Filters come after the routes' limits, as the semantics ask: a narrow filter may return fewer rows
    than exist. Without units or a vector a route is empty.
    """
    units = parse_units(ask.query)
    routes: dict[str, DataFrame] = {}
    if "depth" in chunks.columns and not ask.whole_documents:
        chunks = chunks.where(F.coalesce("depth", F.lit(0)) < 2)
        vectors = vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi") if vectors is not None else None
        if index is not None:
            index = Index(index.posts.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), index.size, index.term_df)
    if ask.use_keyword and (found := keyword_route(chunks, ask.query, index=index)) is not None:
        routes["keyword"] = found
    if ask.use_vector and vectors is not None and query_vector is not None:
        routes["vector"] = vector_route(vectors, query_vector)
    if not routes:
        return chunks.sparkSession.createDataFrame([], "item_key string, score double, base_score double, weight double, best_chunk long, n_chunks long, snippets array<string>, context string, truncated boolean")
    fused = rt.fuse(routes)
    # at most two routes of ROUTE_LIMIT rows: a fixed bound
    rows = chunks.join(F.broadcast(fused), "chunk_id")
    bonus = None
    if "level" in chunks.columns:
        bonus = rows.where("level = 0").groupBy("item_key").agg(F.sum("score").alias("bonus"))
        rows = rows.where("coalesce(level, 1) <> 0")
    boosted = rows.withColumn("score", rt.review_boost(F.col("score"), F.coalesce("kind", F.lit("body"))))
    best = rt.best_per_parent(boosted)
    scored = rt.item_scores(best)
    if bonus is not None:
        scored = scored.join(bonus, "item_key", "left").withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0)))
    scored = scored.join(items, "item_key")
    if keep is not None:
        scored = scored.where(keep)
    weight = F.bround(F.coalesce("multiplier", F.lit(1.0)), 3)
    ranked = scored.join(weights, "item_key", "left").select("item_key", F.bround(F.col("score") * weight, 6).alias("score"), F.col("score").alias("base_score"), weight.alias("weight"), "best_chunk", "n_chunks")
    top = ranked.orderBy(F.desc("score"), "item_key").limit(ask.limit)
    words = F.array(*[F.lit(u) for u, _ in units]) if units else F.array().cast("array<string>")
    place = F.row_number().over(Window.partitionBy("item_key").orderBy(F.desc("score"), "chunk_id"))
    shown = best.withColumn("place", place).where(F.col("place") <= SNIPPETS).select("item_key", "chunk_id", "parent_id", F.struct("place", tx.snippet(F.col("text"), words).alias("t")).alias("s"))
    snippets = shown.groupBy("item_key").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]).alias("snippets"))
    out = top.join(snippets, "item_key", "left")
    if parents is None:
        out = out.withColumns({"context": F.lit(None).cast("string"), "truncated": F.lit(False)})
    else:
        around = boosted.select(F.col("chunk_id").alias("best_chunk"), "parent_id").join(parents.select("parent_id", F.col("text").alias("whole")), "parent_id")
        out = out.join(around.select("best_chunk", F.substring("whole", 1, CONTEXT_CHARS).alias("context"), (F.length("whole") > CONTEXT_CHARS).alias("truncated")), "best_chunk", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    return out.select("item_key", "score", "base_score", "weight", "best_chunk", "n_chunks", "snippets", "context", "truncated")


def diagnostics(chunks: DataFrame, ask: Search, index: Index | None = None) -> dict[str, object]:
    """How a query is read, and how many chunks its narrow recall finds."""
    index = index or Index(rt.postings(chunks), rt.corpus_size(chunks))
    phrases = phrase_terms(ask.query)
    return {
        "tokens": tokenize(ask.query), "phrases": phrases, "units": parse_units(ask.query), "known": any_known(parse_units(ask.query), index.term_df),
        "phrase_hits": rt.phrase_recall(index.posts, phrases, index.size).count() if phrases else 0,
    }
