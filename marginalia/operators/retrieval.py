"""Ranked retrieval: term statistics, postings, the two routes, fusion and item ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import text as tx
from marginalia.operators.relational import kept

#: Fixed values of the ranking.
ROUTE_WEIGHTS = {"keyword": 0.65, "vector": 0.35}
RRF_K, POSITION_DECAY = 60.0, 0.35
ROUTE_LIMIT, MIN_PHRASE_HITS = 200, 5
REVIEW_BOOST, TOP_CHUNKS = 1.1, 3
BM25_K1, BM25_B = 1.2, 0.75
#: A side of at most so many bytes is broadcast; a unit's row takes about UNIT_BYTES besides its text.
BROADCAST_BYTES, UNIT_BYTES = 64 << 20, 64
#: About how many sums of a query and a chunk a task may hold at once.
TASK_SUMS = 1 << 20


def term_df(chunks: DataFrame, text: str = "text", min_df: int = 2) -> DataFrame:
    """(term, df): in how many chunks a term occurs. Partial sums keep the shuffle at one row a term and task."""
    return chunks.select(F.explode(tx.index_terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)


def idf_table(df: DataFrame, n_chunks: int) -> DataFrame:
    """idf = max(0, ln(N / max(df, 1))), N all chunks, indexed or not."""
    return df.select("term", "df", F.greatest(F.lit(0.0), F.log(F.lit(n_chunks) / F.greatest("df", F.lit(1)))).alias("idf"))


def coverage(chunks: DataFrame, units: list[tuple[str, float]], key: str = "chunk_id", text: str = "text", fold_case: bool = False) -> DataFrame:
    """(key, coverage, strong) for chunks that contain a unit of one query; the units are few and inlined.

    Containment is case-sensitive unless ``fold_case``. strong counts hit units of two or more characters.
    """
    body = F.lower(F.col(text)) if fold_case else F.col(text)
    total = sum(w for _, w in units)
    hits = [(F.when(body.contains(u), 1).otherwise(0), u, w) for u, w in units]
    score = sum((h * w for h, _, w in hits), F.lit(0.0)) / F.lit(total or 1.0)
    strong = sum((h for h, u, _ in hits if len(u) >= 2), F.lit(0))
    anything = F.lit(False)
    for u, _ in units:
        anything = anything | body.contains(u)
    return chunks.where(anything).select(key, score.alias("coverage"), strong.cast("int").alias("strong"))


def query_coverage(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", text: str = "text", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """The same for a table of queries, through postings: an equi-join on terms instead of a scan for each query.

    Units are whole terms here (single CJK characters and Latin words), matched lowered. Units that are measured to
    be small are broadcast: postings then stay where they are, and a chunk's hits are summed before the shuffle. Chunks are
    dealt to as many tasks as keep a task's sums near TASK_SUMS, however many chunks there are.
    """
    units = queries.select(query_id, F.explode(tx.coverage_units(F.col(query))).alias("u")).select(query_id, "u.unit", "u.weight").distinct()
    totals = units.groupBy(query_id).agg(F.sum("weight").alias("total"))
    listed = chunks.select(key, tx.index_terms(F.col(text)).alias("__units"))
    tasks = -(-chunks.count() * totals.count() // TASK_SUMS)
    if tasks > listed.rdd.getNumPartitions():
        listed = listed.repartition(tasks)
    posts = listed.select(key, F.explode("__units").alias("unit"))
    size = units.agg(F.coalesce(F.sum(F.octet_length("unit") + F.octet_length(F.col(query_id).cast("string")) + UNIT_BYTES), F.lit(0))).first()[0]
    known = F.broadcast(units) if size <= BROADCAST_BYTES else units
    hits = posts.join(known, "unit").groupBy(query_id, key).agg(F.sum("weight").alias("hit"), F.sum(F.when(F.length("unit") >= 2, 1).otherwise(0)).cast("int").alias("strong"))
    return hits.join(totals, query_id).select(query_id, key, (F.col("hit") / F.col("total")).alias("coverage"), "strong")


def token_list(text: Column) -> Column:
    """The index tokens of a text: lowered words, each CJK character one of its own."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"([{tx.CJK_WIDE}])", " $1 ")
    return F.regexp_extract_all(spaced, F.lit(r"(?U)[\p{L}\p{N}_]+"), F.lit(0))


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(term, key, dl, tf, positions): an inverted index. Stored once, partitioned or bucketed by term, it lets a
    query read its own terms only; filters on term reach below the aggregation."""
    seen = chunks.select(key, token_list(F.col(text)).alias("w")).select(key, F.size("w").alias("dl"), F.posexplode("w").alias("pos", "term"))
    return seen.groupBy("term", key, "dl").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def corpus_size(chunks: DataFrame, text: str = "text") -> tuple[int, float]:
    """How many chunks there are and how many tokens they have on average: one narrow pass, two numbers."""
    n, mean = chunks.select(F.size(token_list(F.col(text))).alias("dl")).agg(F.count("*"), F.avg("dl")).first()
    return int(n), float(mean or 1.0)


def size_of(counted: DataFrame) -> tuple[int, float]:
    """The same from a table that has the number of tokens, dl, of every chunk."""
    n, mean = counted.agg(F.count("*"), F.avg("dl")).first()
    return int(n), float(mean or 1.0)


def _bm25_part(tf: Column, df: Column, dl: Column, size: tuple[int, float]) -> Column:
    n, mean = size
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5)))
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / F.lit(mean or 1.0)))


def bm25(posts: DataFrame, queries: DataFrame, size: tuple[int, float], key: str = "chunk_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, key, bm25), higher is better. ``queries`` has (query_id, term); idf is floored at a tiny positive value.

    ``size``: see corpus_size. Only postings of the queries' terms are shuffled.
    """
    found = posts.join(queries.select("term").distinct(), "term", "left_semi")
    dfs = found.groupBy("term").agg(F.count("*").alias("df"))
    return found.join(dfs, "term").join(queries, "term").groupBy(query_id, key).agg(F.sum(_bm25_part(F.col("tf"), F.col("df"), F.col("dl"), size)).alias("bm25"))


def _follow(positions: list[Column]) -> Column:
    """In how many places the tokens stand one after the other: sorted positions, each moved to the first token's place, are
    intersected, so the cost is linear in them."""
    places = positions[0]
    for i, p in enumerate(positions[1:], 1):
        places = F.array_intersect(places, F.transform(p, _minus(i)))
    return F.size(places)


def _minus(n: int):
    return lambda x: x - n


def counted_in_index(posts: DataFrame, phrases: list[list[str]], key: str = "chunk_id") -> DataFrame:
    """(key, dl, tf0, tf1 ...): how often each phrase, tokens one after the other, stands in a chunk that holds one of their tokens."""
    terms = sorted({t for p in phrases for t in p})
    rows = posts.where(F.col("term").isin(terms)).groupBy(key, "dl").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    at = lambda t: F.coalesce(F.col("at")[t], F.array().cast("array<int>"))
    return rows.select(key, "dl", *[_follow([at(t) for t in p]).alias(f"tf{i}") for i, p in enumerate(phrases)])


def counted_in_texts(chunks: DataFrame, phrases: list[list[str]], key: str = "chunk_id", text: str = "text") -> DataFrame:
    """The same from the texts, for every chunk, without an index and without a shuffle."""
    tokens = chunks.select(key, token_list(F.col(text)).alias("w"))
    terms = sorted({t for p in phrases for t in p})
    placed = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("t"), i.alias("i"))), lambda s: s["t"].isin(terms))
    rows = tokens.select(key, F.size("w").alias("dl"), placed.alias("s"))
    rows = rows.select(key, "dl", *[F.transform(F.filter("s", _is(t)), lambda s: s["i"]).alias(f"at{k}") for k, t in enumerate(terms)])
    at = lambda t: F.col(f"at{terms.index(t)}")
    return rows.select(key, "dl", *[_follow([at(t) for t in p]).alias(f"tf{i}") for i, p in enumerate(phrases)])


def _is(term: str):
    return lambda s: s["t"] == term


def recalled(counted: DataFrame, phrases: list[list[str]], size: tuple[int, float], key: str = "chunk_id", limit: int = 3 * ROUTE_LIMIT, need: list[list[int]] | None = None) -> DataFrame:
    """(key, bm25): the best chunks that hold a phrase, by the sum over phrases; idf is that of the whole phrase.

    ``need``: groups of phrase numbers all of which must be there; any one group is enough, and by default each phrase is a
    group. Phrases are tf0, tf1 ... of ``counted``. Ties go to the smaller key.
    """
    used = range(len(phrases))
    dfs = counted.agg(*[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"n{i}") for i in used]).first()
    score, good = F.lit(0.0), F.lit(False)
    for i in used:
        score = score + F.when(F.col(f"tf{i}") > 0, _bm25_part(F.col(f"tf{i}"), F.lit(float(dfs[i] or 0)), F.col("dl"), size)).otherwise(0.0)
    for group in need or [[i] for i in used]:
        every = F.lit(True)
        for i in group:
            every = every & (F.col(f"tf{i}") > 0)
        good = good | every
    return counted.where(good).select(key, F.round(score, 9).alias("bm25")).orderBy(F.desc("bm25"), key).limit(limit)


def phrase_recall(posts: DataFrame, phrases: list[list[str]], size: tuple[int, float], key: str = "chunk_id", limit: int = 3 * ROUTE_LIMIT, need: list[list[int]] | None = None) -> DataFrame:
    """``recalled`` from an index. What the phrases' postings give is stored, as it is read for the frequencies and again for the scores."""
    return recalled(kept(counted_in_index(posts, phrases, key)), phrases, size, key, limit, need)


def two_tier(phrase: DataFrame, wide: DataFrame, key: str = "chunk_id", query_id: str = "query_id", limit: int = 50) -> DataFrame:
    """Phrase hits first (3 x limit); if a query has fewer than five, wide hits (6 x limit) after them."""
    top = lambda df, n: df.withColumn("__r", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("bm25"), key))).where(F.col("__r") <= n)
    first = top(phrase, 3 * limit).withColumn("tier", F.lit(0))
    counted = first.groupBy(query_id).agg(F.count("*").alias("__n"))
    more = top(wide, 6 * limit).join(counted, query_id, "left").where(F.coalesce("__n", F.lit(0)) < MIN_PHRASE_HITS).drop("__n").withColumn("tier", F.lit(1))
    both = first.unionByName(more)
    return both.withColumn("__k", F.row_number().over(Window.partitionBy(query_id, key).orderBy("tier", "__r"))).where("__k = 1").drop("__k").withColumnRenamed("__r", "place")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; a zero vector counts as length 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    na, nb = norm(a), norm(b)
    return dot(a, b) / (F.when(na > 0, na).otherwise(1.0) * F.when(nb > 0, nb).otherwise(1.0))


def vector_topk(vectors: DataFrame, query: list[float], key: str = "chunk_id", vector: str = "embedding", k: int = ROUTE_LIMIT) -> DataFrame:
    """(key, similarity, raw, rank): the exact nearest by cosine; each task keeps k rows before they meet."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.select(key, cosine(F.col(vector), q).alias("raw")).orderBy(F.desc("raw"), key).limit(k)
    return best.select(key, F.greatest(F.lit(0.0), "raw").alias("similarity"), "raw", F.row_number().over(Window.orderBy(F.desc("raw"), key)).alias("rank"))


def normalized(route: DataFrame, quality: str, by: list[str] | None = None) -> DataFrame:
    """Min-max of a route's quality as ``norm``; a span of nothing gives 1 everywhere."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    low, span = F.min(quality).over(w), F.max(quality).over(w) - F.min(quality).over(w)
    return route.withColumn("norm", F.when(span <= 1e-9, 1.0).otherwise((F.col(quality) - low) / span))


def fuse(routes: dict[str, DataFrame], key: str = "chunk_id", by: list[str] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of routes with (key, norm, rank): (key, score)."""
    weights = weights or ROUTE_WEIGHTS
    parts = None
    for name, route in routes.items():
        place = F.col("rank") - 1
        part = route.select(*(by or []), key, (F.lit(weights[name]) * F.col("norm") * (1 / (1 + POSITION_DECAY * place)) / (RRF_K + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*(by or []), key).agg(F.sum("part").alias("score"))


def best_per_parent(scored: DataFrame, parent: str = "parent_id", key: str = "chunk_id", by: list[str] | None = None) -> DataFrame:
    """The best chunk of each parent; chunks without a parent all stay."""
    w = Window.partitionBy(*(by or []), F.coalesce(F.concat(F.lit("p"), F.col(parent).cast("string")), F.concat(F.lit("c"), F.col(key).cast("string")))).orderBy(F.desc("score"), key)
    return scored.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def item_scores(scored: DataFrame, item: str = "item_key", key: str = "chunk_id", by: list[str] | None = None, top: int = TOP_CHUNKS) -> DataFrame:
    """(item, score, best chunk): the sum of an item's best chunks."""
    w = Window.partitionBy(*(by or []), item).orderBy(F.desc("score"), key)
    ranked = scored.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top)
    return ranked.groupBy(*(by or []), item).agg(F.sum("score").alias("score"), F.min_by(key, "__r").alias("best_chunk"), F.count("*").alias("n_chunks"))


def review_boost(score: Column, kind: Column) -> Column:
    return score * F.when(kind == "review", REVIEW_BOOST).otherwise(1.0)
