"""Near copies by the Jaccard similarity of their sets of five-word shingles.

A document goes if an earlier one that stays is similar to it: in the order of ids the first document stays,
all that are similar to it go, of the rest the first stays, and so on. So no two documents that stay are
similar, and each that goes has a similar one that stays.

Candidates come from MinHash: BANDS keys of ROWS minima each. Two documents of similarity s share
a key with probability 1 - (1 - s**ROWS)**BANDS: 0.9999 at 0.8, more above. Documents that share a
key, directly or through others, form a cluster; each key links its holders to the smallest of
them only, so a large family costs no pairs. Similarities are then taken exactly. Documents of equal
sets are collapsed before. Components are found without the driver (see components.py).

A cluster of at most CLUSTER_DOCS documents and CLUSTER_SHINGLES shingles meets in one task, which finds similar
sets by prefix filtering: with shingles ordered by rarity, two such sets share one of their first
n - ceil(similarity x n) + 1. Of a larger cluster the first PIVOTS documents are compared with one another, and
all others, dealt to many tasks, with those of them that stay. What is left clusters anew, with twice as many pivots in each round up to
PIVOT_SHINGLES shingles, until no large cluster is left; both ways follow the same rule. A cluster of copies
is settled in one round; one of n documents that are alike but not similar enough takes log2(n / PIVOTS) rounds, and beyond
PIVOT_SHINGLES one for so many shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.components import components
from marginalia.llm.shared import one_of_each, packed, stored, unpacked, with_text_key

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 48, 8
SEED = 42
CLUSTER_DOCS, CLUSTER_SHINGLES = 2000, 4_000_000
PIVOTS, PIVOT_SHINGLES, PART_DOCS = 64, 1_000_000, 2000
#: The place of documents that are no pivots.
REST = 1 << 30
_random = np.random.default_rng(20250611)
FLIPS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
FACTORS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
MIX = _random.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
KEY = ["__bare", "__id", "__text"]


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted set of hashes of a text's shingles. Fewer than ``width`` words are one shingle; no words: none."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if not words:
        return np.empty(0, dtype=np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    last = ends[width - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, last)), dtype=np.uint64, count=len(last)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(high), 256):
        least = np.minimum(least, ((high[start : start + 256, None] ^ FLIPS) * FACTORS).min(axis=0))
    return (least.reshape(BANDS, ROWS).astype(np.uint64) * MIX).sum(axis=1, dtype=np.uint64)


def set_name(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def copies(sets: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """Which sets go: those similar to an earlier one that stays."""
    n = len(sets)
    gone = np.zeros(n, dtype=bool)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(n), sizes)
    if not len(owner):
        return gone
    _, ids, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(held, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    ranks = rank[ids]
    ranks = ranks[np.lexsort((ranks, owner))]
    place = np.arange(len(ranks)) - starts[owner]
    used = (place <= sizes[owner] - np.ceil(least * sizes[owner] - 1e-9)) & (held[order][ranks] > 1)
    tokens, holders = ranks[used], owner[used]
    heads = np.searchsorted(holders, np.arange(n + 1))
    by_token = np.argsort(tokens, kind="stable")
    posted, posts = tokens[by_token], holders[by_token]
    marked = np.zeros(len(order), dtype=bool)
    for x in range(n):
        if gone[x]:
            continue
        mine = tokens[heads[x] : heads[x + 1]]
        lists = [posts[a:b] for a, b in zip(np.searchsorted(posted, mine), np.searchsorted(posted, mine, side="right"))]
        near = np.unique(np.concatenate(lists)) if lists else np.empty(0, dtype=np.int64)
        near = near[(near > x) & ~gone[near]]
        near = near[np.minimum(sizes[near], sizes[x]) >= least * np.maximum(sizes[near], sizes[x]) - 1e-9]
        own = ranks[starts[x] : starts[x + 1]]
        marked[own] = True
        for y in near.tolist():
            both = np.count_nonzero(marked[ranks[starts[y] : starts[y + 1]]])
            gone[y] = both >= least * (sizes[x] + sizes[y] - both) - 1e-9
        marked[own] = False
    return gone


class Pivots:
    """The first sets of a large cluster, by which others are tested."""

    def __init__(self, sets: list[np.ndarray], least: float):
        self.gone = copies(sets, least)
        kept = [s for s, g in zip(sets, self.gone) if not g]
        self.least = least
        self.sizes = np.array([len(s) for s in kept], dtype=np.int64)
        tokens, owners = np.concatenate(kept), np.repeat(np.arange(len(kept)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owners = tokens[order], owners[order]

    def similar(self, hashes: np.ndarray) -> bool:
        low, high = np.searchsorted(self.tokens, hashes), np.searchsorted(self.tokens, hashes, side="right")
        n = high - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.bincount(self.owners[at], minlength=len(self.sizes))
        return bool((both >= self.least * (self.sizes + len(hashes) - both) - 1e-9).any())


def _keyed_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(3).cast(pa.binary()).to_pylist()]
            keys = np.concatenate([band_keys(s) for s in sets]) if sets else np.empty(0, dtype=np.uint64)
            ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            nodes = np.array([set_name(s) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64)))], names=[*KEY, "node", "size", "keys"])

    return run


def _small_clusters(width: int, least: float):
    """Rows (root, node, KEY, text) come sorted by root, then KEY. Out go the nodes that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, nodes, sets = None, [], []

        def search() -> pa.RecordBatch:
            lost = [nodes[i] for i in np.flatnonzero(copies(sets, least))]
            return pa.RecordBatch.from_arrays([pa.array(lost, pa.int64()), pa.array([True] * len(lost), pa.bool_())], names=["node", "gone"])

        for batch in batches:
            for root, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(5).cast(pa.binary()).to_pylist()):
                if root != cluster:
                    if len(nodes) > 1:
                        yield search()
                    cluster, nodes, sets = root, [], []
                nodes.append(node)
                sets.append(shingles(text, width))
        if len(nodes) > 1:
            yield search()

    return run


def _large_clusters(width: int, least: float):
    """Rows (root, part, place, node, text) come sorted by root, part and place. The pivots, which have a place, come first in
    each part. Out go the nodes that are decided: the pivots, and what is similar to one of them that stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivots, nodes, sets = None, None, [], []
        out: tuple[list[int], list[bool]] = ([], [])

        def settled() -> Pivots:
            """The group's pivots. What becomes of them goes out once, with part 0."""
            found = Pivots(sets, least)
            if group[1] == 0:
                out[0].extend(nodes)
                out[1].extend(found.gone.tolist())
            return found

        for batch in batches:
            for root, part, place, node, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4).cast(pa.binary()).to_pylist()):
                if (root, part) != group:
                    if group and group[1] == 0 and pivots is None:  # no other row was dealt to it
                        settled()
                    group, pivots, nodes, sets = (root, part), None, [], []
                if place < REST:
                    nodes.append(node)
                    sets.append(shingles(text, width))
                    continue
                if pivots is None:
                    pivots = settled()
                if pivots.similar(shingles(text, width)):
                    out[0].append(node)
                    out[1].append(True)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_())], names=["node", "gone"])
                out = ([], [])
        if group and group[1] == 0 and pivots is None:
            settled()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_())], names=["node", "gone"])

    return run


def drop_near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, cluster_docs: int = CLUSTER_DOCS, cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """``docs`` without the documents that are similar to an earlier one that stays.

    Words are runs of characters other than ASCII white space, A-Z lowered. Texts of fewer than
    ``width`` words are one shingle; null, empty and blank texts are copies of each other. The
    order is that of ids; documents without an id come last, by the hash of their text. Rows that repeat an
    id are one document only if their texts are equal. Texts of any length are read whole. Other columns
    pass through, whatever their names. An empty table gives an empty table. ``cluster_docs`` and
    ``cluster_shingles`` bound what one task holds, not the result.
    """
    keyed = with_text_key(packed(docs, "doc_id", "text"))
    rows = stored(keyed.select(*KEY, "text").mapInArrow(_keyed_rows(width), "__bare boolean, __id long, __text long, node long, size long, keys array<long>"), "shingle-keys")
    leads = stored(rows.groupBy("node").agg(F.min(F.struct(*KEY)).alias("lead"), F.max("size").alias("size")).select("node", "lead.*", "size"), "shingle-sets")
    entries = rows.select("node", F.explode("keys").alias("key")).distinct()
    homes = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
    entries = stored(entries.join(homes.select("key"), "key", "left_semi"), "shingle-entries")
    texts = keyed.select(*KEY, "text")
    decided = None
    for turn in count():
        left = entries if decided is None else entries.join(decided.select("node"), "node", "left_anti")
        homes = left.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
        stars = components(left.join(homes, "key").select(F.col("node").alias("u"), F.col("low").alias("v")).where("u <> v"))
        members = stars.union(stars.select(F.col("root").alias("node"), "root").distinct()).join(leads, "node")
        sizes = stored(members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total")), "shingle-clusters")
        large = (F.col("n") > cluster_docs) | (F.col("total") > cluster_shingles) & (F.col("n") > PIVOTS)
        small = members.join(sizes.where(~large).select("root"), "root", "left_semi")
        asked = texts.join(small, KEY).select("root", "node", *KEY, "text").dropDuplicates(["root", "node"])
        found = stored(asked.repartition("root").sortWithinPartitions("root", *KEY).mapInArrow(_small_clusters(width, similarity), "node long, gone boolean"), "near-copies")
        decided = found if decided is None else decided.union(found)
        if sizes.where(large).isEmpty():
            break
        parts = sizes.where(large).select("root", F.ceil(F.greatest(F.col("n") / PART_DOCS, F.col("total") / CLUSTER_SHINGLES)).alias("parts"))
        order = Window.partitionBy("root").orderBy(*KEY)
        placed = members.join(parts, "root").withColumns({"place": F.row_number().over(order), "__upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
        first = placed.where((F.col("place") <= PIVOTS) | (F.col("place") <= PIVOTS << min(turn, 24)) & (F.col("__upto") <= PIVOT_SHINGLES))
        first = stored(first.select("root", "node", *KEY, "parts", "place"), "near-copies-pivots")
        rest = members.join(parts, "root").join(first.select("node"), "node", "left_anti").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("place", F.lit(REST))
        dealt = first.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        columns = ["root", "part", "place", "node", *KEY]
        asked = texts.dropDuplicates(KEY).join(rest.select(*columns).unionByName(dealt.select(*columns)), KEY).select("root", "part", "place", "node", "text")
        done = stored(asked.repartition("root", "part").sortWithinPartitions("root", "part", "place").mapInArrow(_large_clusters(width, similarity), "node long, gone boolean"), "near-copies")
        decided = decided.union(done)
    kept = leads.join(decided.where("gone").select("node"), "node", "left_anti").select(*KEY)
    return unpacked(one_of_each(keyed.join(kept, KEY, "left_semi"), KEY), docs.columns, "doc_id", "text")
