"""Page edits, stored tables, archives: round trips, injected failures, and files that must stay."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.operators import edits as ed
from marginalia.sources.stored import RestoreRefused, StoredTables

LINES = st.lists(st.sampled_from(["a", "b", "c", "", "d d"]), max_size=14).map("\n".join)


def apply(old, patch):
    lines, out, at = old.split("\n"), [], 0
    for start, gone, new in patch:
        out += lines[at:start] + new
        at = start + gone
    return "\n".join(out + lines[at:])


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=400, deadline=None)
@given(LINES, LINES, st.sampled_from([0, 3, 2000]))
def test_line_patch(old, new, most):
    patch = ed.line_patch(old, new, most)
    assert apply(old, patch) == new
    if most == 2000:  # a shortest patch: what stays is a longest common subsequence
        assert len(old.split("\n")) - sum(gone for _, gone, _ in patch) == longest(old.split("\n"), new.split("\n"))


def test_line_patch_of_long_pages():
    a = [f"line {i % 97}" for i in range(20_000)]
    b = a[:5000] + ["new"] * 30 + a[5100:]
    assert apply("\n".join(a), ed.line_patch("\n".join(a), "\n".join(b))) == "\n".join(b)
    c = [str(i) for i in range(5000)]
    assert apply("\n".join(a), ed.line_patch("\n".join(a), "\n".join(c))) == "\n".join(c)


KEYS = ["k", "page"]


def test_page_diff(spark):
    old = spark.createDataFrame([("x", 1, "a\nb\nc"), ("x", 2, "same"), ("y", 1, None), ("z", 9, "only here")], "k string, page int, text string")
    new = spark.createDataFrame([("x", 1, "a\nB\nc\nd"), ("x", 2, "same"), ("y", 1, "q\n"), ("w", 1, "none")], "k string, page int, text string")
    diff = ed.page_diff(old, new, KEYS)
    got = {(r.k, r.page): [tuple(p) for p in r.patch] for r in diff.collect()}
    assert got == {("x", 1): [(1, 1, ["B"]), (3, 0, ["d"])], ("x", 2): [], ("y", 1): [(0, 0, ["q"])]}
    back = old.join(diff, KEYS).select(*KEYS, ed.patched(F.col("text"), F.col("patch")).alias("text"))
    assert {tuple(r) for r in back.collect()} == {("x", 1, "a\nB\nc\nd"), ("x", 2, "same"), ("y", 1, "q\n")}


LOG = "k string, page int, version int, text string, base string, at string"


def test_edit_log(spark):
    machine = spark.createDataFrame([("x", 1, "one"), ("x", 2, "two"), ("x", 3, None)], "k string, page int, text string")
    log = spark.createDataFrame([], LOG)
    now = lambda log: {(r.k, r.page): r.text for r in ed.current_edits(log, KEYS).collect()}
    add = lambda log, rows: spark.createDataFrame(log.collect() + rows.collect(), LOG)
    drafts = spark.createDataFrame([("x", "## p.1\n\nONE\n\n## p.2\n\ntwo\n\n## p.7\n\nnew page")], "k string, text string")
    log = add(log, ed.save_draft(log, machine, drafts, "t1", "k"))
    assert now(log) == {("x", 1): "ONE", ("x", 7): "new page"} and {r.page: r.base != "" for r in log.collect()} == {1: True, 7: False}
    assert ed.save_draft(log, machine, drafts, "t2", "k").count() == 0
    log = add(log, ed.save_pages(log, machine, spark.createDataFrame([("x", 1, "Eins"), ("x", 3, "drei")], "k string, page int, text string"), "t3", KEYS))
    moved = spark.createDataFrame([("x", 1, "one, parsed anew"), ("x", 3, None)], "k string, page int, text string")
    status = ed.edit_status(log, moved, KEYS, "k").first()
    assert (status.edited, status.stale, status.version, status["at"]) == ([1, 3, 7], [1], 4, "t3")
    back = lambda *rows: spark.createDataFrame(list(rows), "k string, page int, version int")
    log = add(log, ed.restore_pages(log, back(("x", 1, 1), ("x", 3, 5), ("x", 7, 1)), "t4", KEYS))
    assert now(log) == {("x", 1): "ONE", ("x", 3): "drei", ("x", 7): "new page"} and log.count() == 5
    log = add(log, ed.restore_pages(log, back(("x", 1, 0), ("x", 2, 0)), "t5", KEYS))
    assert now(log) == {("x", 3): "drei", ("x", 7): "new page"} and log.count() == 6
    log = add(log, ed.save_pages(log, machine, spark.createDataFrame([("x", 3, "\n")], "k string, page int, text string"), "t6", KEYS))
    assert now(log) == {("x", 7): "new page"}
    assert {r.version for r in log.where("page = 1").collect()} == {1, 2, 3, 4}


def library(spark, root):
    tables = StoredTables(spark, str(root), buckets=8)
    items = [(f"i{n}", n, n % 3) for n in range(40)]
    tables.create("items", spark.createDataFrame(items, "item_key string, item_id int, version int"))
    tables.create("chunks", spark.createDataFrame([(k, 10 * n + c, f"text {n} {c}") for k, n, _ in items for c in range(3)], "item_key string, chunk_id int, text string"))
    return tables


def rows(df):
    return sorted(map(tuple, df.collect()))


def files(root, table):
    return {f for d, _, names in os.walk(f"{root}/{table}") for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet")}


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "item_key string")


def test_rewrite_touches_only_its_buckets(spark, tmp_path):
    t = library(spark, tmp_path)
    before, old = files(tmp_path, "chunks"), rows(t.read("chunks"))
    new = spark.createDataFrame([("i3", 999, "anew", 5), ("new", 1000, "first", None)], "item_key string, chunk_id int, text string, page int")
    t.change({"chunks": new.drop("page")})
    assert rows(t.read("chunks")) == sorted([r for r in old if r[0] != "i3"] + [("i3", 999, "anew"), ("new", 1000, "first")])
    touched = {f"bucket={n}" for n in t._slots(keys(spark, "i3", "new"))}
    stay = {f for f in before if f.split("/")[-2] not in touched}
    assert stay and stay <= files(tmp_path, "chunks") and before - stay and not (before - stay) & files(tmp_path, "chunks")
    assert rows(t.of_items("chunks", keys(spark, "i3", "nobody"))) == [("i3", 999, "anew")]
    t.change(gone={"chunks": t.read("chunks").select("item_key")})
    assert rows(t.read("chunks").limit(1)) == [] if files(tmp_path, "chunks") else True


def test_lost_driver_before_and_after_the_commit(spark, tmp_path, monkeypatch):
    t = library(spark, tmp_path)
    old = rows(t.read("items"))
    new = spark.createDataFrame([("i1", 1, 77)], "item_key string, item_id int, version int")

    def lost(self, name):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(StoredTables, "_commit", lost)
        with pytest.raises(OSError, match="lost"):
            t.change({"items": new})
    assert rows(t.read("items")) == old and t.recover() == [] and rows(t.read("items")) == old and not os.path.exists(f"{tmp_path}/_staged")
    with monkeypatch.context() as m:
        m.setattr(StoredTables, "_carry_out", lost)
        with pytest.raises(OSError, match="lost"):
            t.change({"items": new})
    assert len(t.recover()) == 1 and rows(t.read("items")) == sorted([r for r in old if r[0] != "i1"] + [("i1", 1, 77)]) and t.recover() == []


def test_archive_and_restore(spark, tmp_path, monkeypatch):
    t = library(spark, tmp_path)
    items, chunks, ids = rows(t.read("items")), rows(t.read("chunks")), {"items": "item_id", "chunks": "chunk_id"}
    assert t.archive(keys(spark, "i1", "i2", "nobody"), "b1") == {"chunks": 6, "items": 2} == t.archives()["b1"]
    assert not {"i1", "i2"} & {r[0] for r in rows(t.read("chunks"))} and len(rows(t.read("items"))) == 38
    with pytest.raises(ValueError, match="b1"):
        t.archive(keys(spark, "i5"), "b1")

    def lost(self, name):
        raise OSError("lost")

    gone = rows(t.read("chunks"))
    with monkeypatch.context() as m:
        m.setattr(StoredTables, "_commit", lost)
        with pytest.raises(OSError, match="lost"):
            t.restore("b1", ids)
    t.recover()
    assert rows(t.read("chunks")) == gone and "b1" in t.archives()
    t.restore("b1", ids, {"items": {"version": F.lit(5)}})
    assert rows(t.read("chunks")) == chunks and rows(t.read("items")) == sorted((k, i, 5 if k in ("i1", "i2") else v) for k, i, v in items) and t.archives() == {}
    with monkeypatch.context() as m:
        m.setattr(StoredTables, "_carry_out", lost)
        with pytest.raises(OSError, match="lost"):
            t.archive(keys(spark, "i1", "i2"), "b2")
    t.recover()
    assert t.archives() == {"b2": {"chunks": 6, "items": 2}} and rows(t.read("chunks")) == gone
    t.purge("b2")
    assert t.archives() == {}


def test_restore_is_refused_whole(spark, tmp_path):
    t = library(spark, tmp_path)
    t.archive(keys(spark, "i1", "i2"), "b1")
    t.change({"chunks": spark.createDataFrame([("late", 21, "took an id of i2")], "item_key string, chunk_id int, text string")})
    before = rows(t.read("items")), rows(t.read("chunks"))
    with pytest.raises(RestoreRefused) as refused:
        t.restore("b1", {"items": "item_id", "chunks": "chunk_id"})
    assert refused.value.conflicts == ["chunks 21 (late)"]
    assert (rows(t.read("items")), rows(t.read("chunks"))) == before and t.archives() == {}
    assert os.path.exists(f"{tmp_path}/_archives/b1.stale")
