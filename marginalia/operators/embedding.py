"""Passage vectors: batches through a model that each worker process loads once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import UNINDEXED_KINDS
from marginalia.operators.relational import current_vectors

BATCH = 32
VECTOR = "chunk_id long, dim int, vector array<float>, model string"
#: A model: texts to rows of numbers.
Model = Callable[[list[str]], np.ndarray]


def to_embed(chunks: DataFrame, vectors: DataFrame | None = None, kinds: str = "section") -> DataFrame:
    """The searched chunks (level 1, no contents, references or the like) that have no vector yet: chunk_id, text."""
    searched = chunks.where("level = 1")
    if kinds in chunks.columns:
        searched = searched.where(~F.coalesce(kinds, F.lit("")).isin(*UNINDEXED_KINDS))
    return (searched if vectors is None else searched.join(vectors.select("chunk_id"), "chunk_id", "left_anti")).select("chunk_id", "text")


def embed_passages(chunks: DataFrame, load: Callable[[], Model], model: str, batch: int = BATCH) -> DataFrame:
    """(chunk_id, dim, vector, model) for every row of (chunk_id, text) whose batch of ``batch`` texts the model takes.

    ``load`` makes the model, once for each worker process and name. A batch that fails, or a model that can't be loaded,
    leaves its rows out: they have no vector, are found by keywords still, and are tried again by the next run. Rows whose numbers aren't
    finite are left out too. Null texts count as empty. No shuffle: partitions are embedded as they come.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import builtins

        loaded = builtins.__dict__.setdefault("_marginalia_models", {})  # lives as long as the worker
        if model not in loaded:
            try:
                loaded[model] = load()
            except Exception:  # noqa: BLE001 a model that isn't there must not fail the job
                return
        for part in parts:
            ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            kept_ids, rows = [], []
            for i in range(0, len(texts), batch):
                try:
                    found = np.asarray(loaded[model](texts[i : i + batch]), dtype=np.float32)
                    if found.ndim != 2 or len(found) != len(texts[i : i + batch]):
                        continue
                except Exception:  # noqa: BLE001 one bad batch must not fail the job
                    continue
                good = np.isfinite(found).all(axis=1)
                kept_ids += [x for x, ok in zip(ids[i : i + batch], good) if ok]
                rows += list(found[good])
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept_ids, pa.int64()), pa.array([len(r) for r in rows], pa.int32()), pa.array([r.tolist() for r in rows], pa.list_(pa.float32())), pa.array([model] * len(rows), pa.string())],
                names=["chunk_id", "dim", "vector", "model"],
            )

    return chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "text").mapInArrow(run, VECTOR)


def refresh_vectors(chunks: DataFrame, vectors: DataFrame, load: Callable[[], Model], model: str, last_model: str | None, batch: int = BATCH) -> DataFrame:
    """All vectors after a build: those that still count, without those of chunks that are gone, and new ones of chunks that had none.

    Vectors of another model go only if the last build names another model.
    """
    known = current_vectors(vectors, model, last_model).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return known.unionByName(embed_passages(to_embed(chunks, known), load, model, batch))
