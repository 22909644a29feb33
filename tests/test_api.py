"""Views, outlines and the knowledge base as a whole."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import outline, views
from marginalia.plans.api import KnowledgeBase


@pytest.fixture(scope="module")
def kb(spark):
    t = {
        "items": spark.createDataFrame(
            [("a", "Alpha beta study", "2024", "Doe", "Doe J", "J. X", "10.1000/A", "About alpha.", "", ["Reading"], 1, 100), ("b", "Gamma work", "2005", "Roe", "Roe R", "", "", "On gamma alpha.", "", ["Other"], 0, 50)],
            "item_key string, title string, year string, first_author string, author_line string, venue string, doi string, abstract string, summary string, collections array<string>, n_pdfs int, fulltext_chars int"),
        "pages": spark.createDataFrame([("a", 1, "# 1 Start\nAlpha beta are studied here. " + "More words follow. " * 30), ("a", 2, "# References\n[1] alpha"), ("b", 1, "Gamma is not alpha but long enough to index.")], "item_key string, page int, text string"),
        "figures": spark.createDataFrame([(1, "a", 1, "figure", "Fig. 1", "alpha curve"), (2, "a", 2, "table", "Table 1", "numbers")], "fig_id int, item_key string, page int, kind string, label string, text string"),
        "notes": spark.createDataFrame([("a", "a note")], "item_key string, note string"),
        "extras": spark.createDataFrame([("a", "TP1")], "item_key string, clc string"),
        "experience": spark.createDataFrame([(1, "2024-01-01", "alpha", "m", "effective", ["b"], ["T"], None, None)], "id long, created_at string, asked string, method string, outcome string, item_keys array<string>, tags array<string>, context string, reason string"),
        "weights": spark.createDataFrame([("a", 0, 0.0)], "item_key string, pinned int, manual double"),
        "health": spark.createDataFrame([("a", "ok")], "item_key string, verdict string"),
        "vectors": spark.createDataFrame([(1,)], "chunk_id long"),
        "merges": spark.createDataFrame([("old", "a")], "old_key string, new_key string"),
        "tombstones": spark.createDataFrame([("x", "deleted")], "key string, kind string"),
    }
    return KnowledgeBase({k: v for k, v in t.items() if k != "vectors"}, 2024).reindex()


def test_search_and_weights(kb):
    got = {r.item_key: r for r in kb.search("alpha", whole_documents=True).collect()}
    assert [r.item_key for r in kb.search("alpha").collect()] == ["b"]
    assert set(got) == {"a", "b"} and got["b"].weight > got["a"].weight
    assert [r.item_key for r in kb.search("alpha", year_from=2010, whole_documents=True).collect()] == ["a"]
    assert [r.item_key for r in kb.search("alpha", collection="Other").collect()] == ["b"]


def test_chunks_know_their_parents(kb):
    kids = kb.tables["chunks"].where("level = 1 AND depth = 0").collect()
    parents = {r.chunk_id for r in kb.tables["chunks"].where("level = 0").collect()}
    assert kids and all(k.parent_id in parents for k in kids)


def test_ledger_roundtrip(kb):
    new = kb.tables["experience"].withColumn("asked", F.lit("other")).drop("id")
    more = kb.add_experience(new.unionByName(kb.tables["experience"].drop("id")))
    assert sorted(r.id for r in more.tables["experience"].collect()) == [1, 2]
    assert [r.asked for r in more.experience(item="b", tag="t").collect()] == ["other", "alpha"]
    assert kb.related_experience("alpha", []).count() == 1


def test_lookups(kb, spark):
    assert [r.fig_id for r in kb.figures("alpha").collect()] == [1]
    item = kb.item("a").first()
    assert item.clc == "TP1" and len(item.figures) == 2 and item.notes == ["a note"] and item.experience is None
    assert kb.fulltext("a", 2).first().text == "## p.2\n\n# References\n[1] alpha"
    asked = spark.createDataFrame([(0, "doi:10.1000/a"), (1, "10.1000/A"), (2, "nope")], "pos int, doi string")
    assert [(r.pos, r.ok, r.item_key) for r in kb.plan_acquisition(asked).collect()] == [(0, True, "a"), (2, False, None)]
    refs = {r.key: r.status for r in kb.references(spark.createDataFrame([("a",), ("old",), ("x",), ("?",)], "key string")).collect()}
    assert refs == {"a": "live", "old": "merged", "x": "deleted", "?": "unknown"}
    files = spark.createDataFrame([("a", "p1"), ("a", "p1"), ("zz", "p")], "item_key string, path string")
    assert {r.item_key: r.n_pdfs for r in kb.attach(files).tables["items"].collect()} == {"a": 2, "b": 0}


def test_views(kb, spark):
    t = kb.tables
    card = {r.item_key: r.markdown for r in views.item_card(t["items"]).collect()}
    assert card["a"].startswith("# Alpha beta study\n\n- **Authors**: Doe J") and "DOI" not in card["b"]
    assert "**Fig. 1** alpha curve" in views.figure_view(t["figures"]).first().markdown
    levels = views.level_rows(spark.createDataFrame([("a", "L2")], "item_key string, level string")).collect()
    assert len(levels) == 6 and sum(r.present for r in levels) == 1
    posts = t["chunks"].where("level = 1").select("chunk_id")
    checks = {r.check: r.ok for r in views.invariants(t["chunks"], posts, posts).collect()}
    assert all(checks.values())
    assert not {r.check: r.ok for r in views.invariants(t["chunks"], posts.limit(0), posts).collect()}["postings complete"]
    left = views.cascade(t, spark.createDataFrame([("a",)], "item_key string"))
    assert left["items"].count() == 1 and left["experience"].count() == t["experience"].count()
    plan = views.repair_plan(spark.createDataFrame([("b", "bad")], "item_key string, verdict string"), t["pages"]).first()
    assert plan.scanned and plan.pages == 1


def test_advice(spark):
    members = spark.createDataFrame([("c1", "a"), ("c2", "b")], "collection string, item_key string")
    items = spark.createDataFrame([("a",), ("z",)], "item_key string")
    pairs = spark.createDataFrame([("c1", "c2")], "a string, b string")
    got = {tuple(r) for r in views.collection_advice(members, items, pairs, pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).collect()}
    assert got == {("overlap", "c1", "c2"), ("small", "c1", None), ("small", "c2", None), ("unclassified", "z", None)}


def test_inventories(spark):
    x = spark.createDataFrame([("A: 1\nB: x;y",), ("A: 2",)], "extra string")
    assert {(r.key, r.n, r.shape) for r in views.key_inventory(x).collect()} == {("A", 2, "number"), ("B", 1, "list")}
    titles = spark.createDataFrame([("深度学习",), ("机器学习",), ("学习方法",), ("学习方法",)], "title string")
    assert [tuple(r) for r in views.domain_grams(titles).collect()] == [("学习", 3)]
    lost = views.fields_lost(spark.createDataFrame([("i", "book", {"issn": "1", "title": "t", "empty": ""})], "item string, target string, fields map<string,string>"), spark.createDataFrame([("book", "title")], "type string, field string"))
    assert [tuple(r) for r in lost.collect()] == [("i", "issn")]


def test_outline_status(spark):
    items = spark.createDataFrame([("a",), ("b",)], "key string")
    metas = spark.createDataFrame([("a", '{"sections": [1, 2]}')], "key string, v string")
    files = spark.createDataFrame([("a",), ("c",)], "key string")
    assert {(r.key, r.sections, r.state) for r in outline.outline_status(items, metas, files, "key").collect()} == {("a", 2, "ready"), ("b", 0, "none"), ("c", 0, "orphan")}
    now = spark.createDataFrame([("a", "f1"), ("a", "f2")], "key string, fp string")
    old = spark.createDataFrame([("a", "f1", "s")], "key string, fp string, summary string")
    assert {(r.fp, r.todo) for r in outline.reuse_summaries(now, old, "key").collect()} == {("f1", False), ("f2", True)}


def test_replace_formula():
    text = "x $$a = b \\tag{1}$$ y $$c$$"
    assert outline.replace_formula(text, "z", nth=1) == "x $$a = b \\tag{1}$$ y $$\nz\n$$"
    assert outline.replace_formula(text, "z", old="a=b") == "x $$\nz \\tag{1}\n$$ y $$c$$"
    assert outline.replace_formula(text, "z", nth=9) == text
