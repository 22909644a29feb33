"""Passage vectors with a stand-in model; layouts by fingerprint."""

import json
import os

import numpy as np
from pyspark.sql import functions as F

from marginalia.operators import embedding as em
from marginalia.sources import files


def stand_in():
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return np.array([[len(t), t.count("e"), 1.0 if "nan" not in t else np.nan] for t in texts])

    return model


CHUNK = "chunk_id long, level int, section string, text string"


def test_passages(spark):
    chunks = spark.createDataFrame([(i, 1, "body", "e" * i) for i in range(70)] + [(100, 1, "body", None), (101, 1, "refs", "x"), (102, 0, "body", "y"), (103, 1, None, "a nan")], CHUNK).coalesce(1)
    got = {r.chunk_id: (r.dim, list(r.vector), r.model) for r in em.embed_passages(em.to_embed(chunks), stand_in, "m1").collect()}
    assert got[5] == (3, [5.0, 5.0, 1.0], "m1") and got[100] == (3, [0.0, 0.0, 1.0], "m1") and set(got) == {*range(70), 100}


def test_a_failed_batch_leaves_its_rows_without_vectors(spark):
    chunks = spark.createDataFrame([(i, 1, "body", "bad" if i == 40 else "good") for i in range(100)], CHUNK).coalesce(1)
    got = em.embed_passages(em.to_embed(chunks), stand_in, "m2")
    assert {r.chunk_id for r in got.collect()} == {*range(100)} - {*range(32, 64)}

    def broken():
        raise OSError("no such model")

    assert em.embed_passages(em.to_embed(chunks), broken, "m3").count() == 0
    assert em.embed_passages(em.to_embed(chunks.limit(0)), stand_in, "m2").count() == 0


def test_only_missing_vectors_are_made(spark):
    chunks = spark.createDataFrame([(1, 1, "body", "one"), (2, 1, "body", "two"), (3, 1, "body", "three")], CHUNK)
    old = spark.createDataFrame([(1, 1, [9.0], "old"), (7, 1, [9.0], "old")], em.VECTOR)
    same = {r.chunk_id: (list(r.vector), r.model) for r in em.refresh_vectors(chunks, old, stand_in, "new", None).collect()}
    assert same == {1: ([9.0], "old"), 2: ([3.0, 0.0, 1.0], "new"), 3: ([5.0, 2.0, 1.0], "new")}
    other = {r.chunk_id: r.model for r in em.refresh_vectors(chunks, old, stand_in, "new", "old").collect()}
    assert other == {1: "new", 2: "new", 3: "new"}


def layout(*contents):
    return json.dumps({"pages": [{"blocks": [{"type": "text", "content": c, "level": None, "captions": ["cap", "tion"], "image_source": "i.png"} for c in contents]}, {"blocks": []}]})


def test_layouts_by_fingerprint(spark, tmp_path):
    root = tmp_path / "layouts"
    (root / "deep").mkdir(parents=True)
    (root / "a.json").write_text(layout("one", "two"))
    (root / "deep" / "b.json").write_text(layout("three"))
    (root / "c.json").write_text("{ half of")
    (root / "other.txt").write_text("x")
    os.utime(root / "a.json", (1_000_000, 1_000_000))
    first = {(r.doc, r.page, r.pos, r.content, r.caption, r.image) for r in files.read_layout(spark, str(root)).collect()}
    assert first == {("a", 1, 0, "one", "cap tion", "i.png"), ("a", 1, 1, "two", "cap tion", "i.png"), ("b", 1, 0, "three", "cap tion", "i.png")}
    none = spark.createDataFrame([], files.FINGERPRINT)
    changed, seen, gone = files.changed_files(spark, str(root), none)
    assert changed.count() == 3 and gone.count() == 0
    known = spark.createDataFrame(seen.collect(), files.FINGERPRINT)
    assert [f.count() for f in files.changed_files(spark, str(root), known)] == [0, 3, 0]
    # touched but not changed; changed; gone; new
    os.utime(root / "a.json", (2_000_000, 2_000_000))
    (root / "deep" / "b.json").write_text(layout("four"))
    (root / "c.json").unlink()
    (root / "d.json").write_text(layout("five"))
    changed, seen, gone = files.changed_files(spark, str(root), known)
    name = lambda df: sorted(r.path.rpartition("/")[2] for r in df.collect())
    assert name(changed) == ["b.json", "d.json"] and name(gone) == ["c.json"] and name(seen) == ["a.json", "b.json", "d.json"]
    blocks = files.read_layout(spark, str(root)).where("doc = 'a'").withColumn("content", F.lit("kept")).unionByName(spark.createDataFrame([("b", 1, 0, "text", "stale", None, "", ""), ("c", 1, 0, "text", "gone", None, "", "")], "doc string, page int, pos int, type string, content string, level int, caption string, image string"))
    after, prints = files.refresh_layout(spark, str(root), blocks, known)
    assert sorted((r.doc, r.content) for r in after.collect()) == [("a", "kept"), ("a", "kept"), ("b", "four"), ("d", "five")] and prints.count() == 3
