"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Equal vectors are collapsed first: a copy adds its id to the one node of its vector. Nodes are
dealt to shards by hash. In a shard a directed graph is built: greedy searches from the
medoid propose neighbours for each node, and robust pruning keeps a neighbour only if no kept
one is nearer to it by the factor ALPHA, so that edges point in different directions. Every
query is searched in every shard by beam search; the shards' best are merged by exact distance.

Building and searching run many nodes in step, as numpy operations. The graph is a fixed number
of bytes a node, and a shard has at most about SHARD_ROWS nodes, so memory is bounded; queries
come in blocks of QUERY_BLOCK.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.shared import stored

DEGREE, BEAM, ALPHA = 32, 48, 1.2
SEARCH_BEAM = 128
SHARD_ROWS = 8192
QUERY_BLOCK = 4096
#: Queries searched and scored together.
QUERY_SLICE = 256
SALTS = 32
#: Distinct vectors that a task collapses together.
HELD_VECTORS = 50_000


class Points:
    """Vectors for building and searching: single precision with their squared lengths. Answers are
    measured again in double precision."""

    def __init__(self, exact: np.ndarray):
        self.exact = exact
        self.v = exact.astype(np.float32)
        self.norm = np.einsum("nd,nd->n", self.v, self.v)

    def __len__(self) -> int:
        return len(self.v)


def distances(points: Points, ids: np.ndarray, queries: np.ndarray, found: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of each query to its row of ids; -1 is no point, infinitely far. ``found`` may hold the ids' vectors."""
    at = np.maximum(ids, 0)
    found = points.v[at] if found is None else found
    d = points.norm[at] - 2 * np.matmul(found, queries[:, :, None])[:, :, 0] + np.einsum("bd,bd->b", queries, queries)[:, None]
    return np.where(ids < 0, np.float32(np.inf), np.maximum(d, 0))


def beam_search(points: Points, graph: np.ndarray, start: int, queries: np.ndarray, width: int, keep_seen: bool = False):
    """The ``width`` nearest nodes found for each query, nearest first; and all nodes expanded."""
    n = len(queries)
    ids = np.full((n, width), -1, dtype=np.int32)
    ids[:, 0] = start
    dist = np.full((n, width), np.inf, dtype=np.float32)
    dist[:, 0] = distances(points, ids[:, :1], queries)[:, 0]
    done = np.zeros((n, width), dtype=bool)
    met = np.zeros((n, len(points)), dtype=bool)
    met[:, start] = True
    expanded: list[np.ndarray] = []
    live = np.arange(n)
    while len(live):
        waiting = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
        best = waiting.argmin(axis=1)
        going = np.isfinite(waiting[np.arange(len(live)), best])
        live, best = live[going], best[going]
        if not len(live):
            break
        node = ids[live, best]
        done[live, best] = True
        if keep_seen:
            step = np.full(n, -1, dtype=np.int32)
            step[live] = node
            expanded.append(step)
        near = graph[node]
        near = np.where((near >= 0) & ~met[live[:, None], np.maximum(near, 0)], near, -1)
        rows, cols = np.nonzero(near >= 0)
        met[live[rows], near[rows, cols]] = True
        far = distances(points, near, queries[live])
        all_d = np.concatenate([dist[live], far], axis=1)
        pick = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        dist[live] = np.take_along_axis(all_d, pick, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), pick, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros_like(near, dtype=bool)], axis=1), pick, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    out = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    return (*out, np.stack(expanded, axis=1) if expanded else np.empty((n, 0), dtype=np.int32)) if keep_seen else out


def robust_prune(points: Points, nodes: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each node, up to ``degree`` of its candidates: the nearest left is kept, and those that it
    is nearer to, by the factor alpha, than the node is are dropped. -1 fills the rest."""
    kept = np.full((len(nodes), degree), -1, dtype=np.int32)
    cand = np.sort(candidates, axis=1)
    cand = np.where((cand == nodes[:, None]) | np.c_[np.zeros(len(cand), dtype=bool), cand[:, 1:] == cand[:, :-1]], -1, cand)
    dist = distances(points, cand, points.v[nodes])
    order = np.argsort(dist, axis=1, kind="stable")[:, : 3 * degree]
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    vectors = points.v[np.maximum(cand, 0)]
    left = dist.copy()
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = left.argmin(axis=1)
        ok = np.isfinite(left[rows, best])
        if not ok.any():
            break
        chosen = np.where(ok, cand[rows, best], -1)
        kept[:, k] = chosen
        between = distances(points, cand, points.v[np.maximum(chosen, 0)], vectors)
        drop = (alpha * alpha * between <= dist) & ok[:, None]
        left = np.where(drop, np.inf, left)
        left[rows, best] = np.inf
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, block: int = 256) -> tuple[np.ndarray, int]:
    """Adjacency (n, degree) and the start node. Two passes, the first with half the beam, the second with ALPHA."""
    n = len(points)
    rng = np.random.default_rng(n)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    points = Points(points)
    graph = rng.integers(0, n, size=(n, degree), dtype=np.int32) if n > 1 else np.full((n, degree), -1, dtype=np.int32)
    graph[graph == np.arange(n)[:, None]] = -1
    if n <= 2:
        return graph, start
    for alpha, width in ((1.0, beam // 2), (ALPHA, beam)):
        order = rng.permutation(n).astype(np.int32)
        for a in range(0, n, block):
            nodes = order[a : a + block]
            found, _, seen = beam_search(points, graph, start, points.v[nodes], width, keep_seen=True)
            graph[nodes] = robust_prune(points, nodes, np.concatenate([found, seen, graph[nodes]], axis=1), alpha, degree)
            # the way back: a node that is full is pruned again with its new neighbours
            source = np.repeat(nodes, degree)
            target = graph[nodes].ravel()
            source, target = source[target >= 0], target[target >= 0]
            known = (graph[target] == source[:, None]).any(axis=1)
            source, target = source[~known], target[~known]
            sort = np.argsort(target, kind="stable")
            source, target = source[sort], target[sort]
            touched, first, count = np.unique(target, return_index=True, return_counts=True)
            if not len(touched):
                continue
            extra = np.full((len(touched), count.max()), -1, dtype=np.int32)
            slot = np.arange(len(target)) - np.repeat(first, count)
            extra[np.repeat(np.arange(len(touched)), count), slot] = source
            free = (graph[touched] < 0).sum(axis=1)
            fits = count <= free
            for t, f, c in zip(touched[fits], first[fits], count[fits]):
                row = graph[t]
                row[np.flatnonzero(row < 0)[:c]] = source[f : f + c]
            full = ~fits
            if full.any():
                graph[touched[full]] = robust_prune(points, touched[full], np.concatenate([graph[touched[full]], extra[full]], axis=1), alpha, degree)
    return graph, start


def search_shard(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers and exact distances, by double precision differences, of up to k nodes found, ties to the smaller number.

    Queries are searched and scored QUERY_SLICE at a time, which bounds what is held to that many times the beam vectors.
    """
    width = max(beam, k)
    light = Points(points) if len(points) > width else None
    most = min(k, len(points))
    found = [(np.empty((0, most), dtype=np.int32), np.empty((0, most)))]
    for a in range(0, len(queries), QUERY_SLICE):
        asked = queries[a : a + QUERY_SLICE]
        if light is None:
            ids = np.tile(np.arange(len(points), dtype=np.int32), (len(asked), 1))
        else:
            ids = beam_search(light, graph, start, asked.astype(np.float32), width)[0]
        exact = np.sqrt(((points[np.maximum(ids, 0)] - asked[:, None, :]) ** 2).sum(axis=2))
        exact[ids < 0] = np.inf
        order = np.lexsort((ids, exact), axis=1)[:, :k]
        found.append((np.take_along_axis(ids, order, 1), np.take_along_axis(exact, order, 1)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has only finite components, not all of them zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & F.col("vec_id").isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0))


def _collapse(k: int):
    """Within a task: each distinct vector once, with its k smallest ids, as far as HELD_VECTORS of them go. Rows: key, ids."""

    def sent(held: dict[bytes, list[int]]) -> list[pa.RecordBatch]:
        table = pa.table({"key": pa.array(list(held), pa.binary()), "ids": pa.array([sorted(x) for x in held.values()], pa.list_(pa.int64()))})
        return table.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = held.setdefault(np.asarray(vector, dtype="<f8").tobytes(), [])
                if vec_id not in ids:
                    ids.append(vec_id)
                    if len(ids) > k:
                        ids.remove(max(ids))
            if len(held) > HELD_VECTORS:
                yield from sent(held)
                held = {}
        if held:
            yield from sent(held)

    return run


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes are numbered by their smallest id, so that equal distances go to the smaller id."""
    pdf = pdf.sort_values("low", kind="stable")
    points = np.frombuffer(b"".join(pdf["key"]), dtype="<f8").reshape(len(pdf), -1)
    graph, start = build_graph(points)
    return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "points": [points.tobytes()], "lows": [pdf["low"].to_numpy(dtype="<i8").tobytes()], "graph": [graph.tobytes()], "start": [start]})


def _search(k: int):
    def run(key, shards: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        asked = np.frombuffer(b"".join(queries["key"]), dtype="<f8").reshape(len(queries), -1) if len(queries) else None
        for shard in shards.itertuples() if len(queries) else ():
            points = np.frombuffer(shard.points, dtype="<f8").reshape(-1, shard.dim)
            graph = np.frombuffer(shard.graph, dtype=np.int32).reshape(len(points), -1)
            ids, dist = search_shard(points, graph, int(shard.start), asked, k)
            rows, cols = np.nonzero(np.isfinite(dist))
            node = ids[rows, cols]
            lows = np.frombuffer(shard.lows, dtype="<i8")[node]
            found.append(pd.DataFrame({"key": queries["key"].to_numpy()[rows], "near": [points[i].tobytes() for i in node], "low": lows, "score": dist[rows, cols]}))
        return pd.concat(found) if found else pd.DataFrame({"key": pd.Series(dtype=object), "near": pd.Series(dtype=object), "low": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding") -> DataFrame:
    """The k nearest rows of ``vectors`` found for each row of ``queries`` (vec_id, vector), itself left
    out: query_id, rank (from 1), vec_id, score (Euclidean distance in double precision).

    Nearest first, ties to the smaller vec_id. Vectors that are null, empty, zero or hold a null
    or non-finite component take no part, on either side, nor do rows without an id; vectors of
    different lengths are never compared. Rows that repeat an id and a vector count once. Of
    thousands of equal vectors the k + 1 with the smallest ids are enough for any answer. Other
    columns are not used. Without queries or vectors there are no rows.
    """
    wide = k + 1  # the query's own row is among the nearest and is left out at the end
    dim = (F.octet_length("key") / 8).cast("int")
    collapse = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_collapse(wide), "key binary, ids array<long>")
    nodes = stored(
        collapse(usable(vectors, vector)).groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, wide).alias("ids"))
        .withColumn("dim", dim),
        "ann-nodes",
    )
    n = nodes.count()
    shards = max(1, -(-n // SHARD_ROWS))
    index = stored(
        nodes.select("key", "dim", F.get("ids", F.lit(0)).alias("low"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))
        .groupBy("dim", "shard").applyInPandas(_build, "dim int, shard int, points binary, lows binary, graph binary, start long"),
        "ann-index",
    )
    asked = stored(usable(queries, vector).select(F.col("vec_id").cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v")), "ann-queries")
    distinct = stored(asked.select(F.col("query_id").alias("vec_id"), "v").mapInArrow(_collapse(1), "key binary, ids array<long>").select("key").distinct().withColumn("dim", dim), "ann-distinct")
    blocks = max(1, -(-distinct.count() // QUERY_BLOCK))
    # each shard meets each block of queries once
    placed = distinct.withColumn("block", F.pmod(F.xxhash64("key", F.lit("block")), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    found = spread.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(_search(wide), "key binary, near binary, low long, score double")
    by_key = Window.partitionBy("key").orderBy("score", "low")
    best = found.withColumn("r", F.row_number().over(by_key)).where(F.col("r") <= wide)
    # of equal vectors each has its own row again; a hot query vector is dealt out by a salt
    answers = (
        best.join(nodes.select(F.col("key").alias("near"), "ids"), "near").select("key", "score", F.explode("ids").alias("vec_id"))
        .groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, wide).alias("found"))
    )
    answers = stored(answers, "ann-answers").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = asked.mapInArrow(_keys, "query_id long, key binary").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int")).distinct()
    return (
        rows.join(answers, ["key", "salt"])
        .select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
        .select("query_id", F.posexplode("found").alias("pos", "f"))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
    )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.asarray(v, dtype="<f8").tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["query_id", "key"])


def recall_at(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (query_id, vec_id) that were found."""
    total = exact.count()
    return found.join(exact, ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0
