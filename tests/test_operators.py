"""Operators on small hand-made tables."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.operators import chunking as ck
from marginalia.operators import extraction as ex
from marginalia.operators import ledger as lg
from marginalia.operators import relational as rl
from marginalia.operators import retrieval as rt
from marginalia.operators import views as vw
from marginalia.plans.search import Search, search
from marginalia.sources import files, library
from marginalia.streaming import sessions


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab。. \n汉", max_size=2000))
def test_child_windows(text):
    found = ck.child_windows(text)
    assert all(piece == text[at : at + len(piece) + 60 + 300].strip()[: len(piece)] or piece in text[at:] for at, piece in found)
    assert all(len(p) <= 360 for _, p in found[:-1] or found) or len(found) == 1
    starts = [at for at, _ in found]
    assert starts == sorted(set(starts))
    assert bool(found) == bool(text.strip())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab ", min_size=1, max_size=900), max_size=12))
def test_parent_parts(paragraphs):
    text = "\n\n".join(paragraphs)
    parts = ck.parent_parts(text)
    assert all(text[at : at + len(p)] == p for at, p in parts)
    assert "".join("".join(p.split()) for _, p in parts) == "".join(text.split())


def test_packed_paragraphs():
    text = "\n\n".join(f"Paragraph {i} " + "word " * 40 for i in range(10))
    found = ck.packed_paragraphs(text)
    assert len(found) > 1 and all(len(c) >= 120 for c in found)
    assert ck.packed_paragraphs("short") == [] and ck.packed_paragraphs(None) == []


def test_sections():
    pages = [(1, "# 1 Intro\nhello\n## 1.1 Part\nmore\n# Notes\nsame level"), (2, "# References\n[1] a\n# 1.2.3 Not a section\nb\n# Appendix\nz")]
    got = [(s["title"], s["level"], s["kind"]) for s in ck.sections(pages)]
    assert ("1 Intro", 1, "body") in got and ("1.1 Part", 2, "body") in got and ("Notes", 2, "body") in got
    assert ("References", 2, "refs") in got and ("Appendix", 2, "appendix") in got
    assert ck.sections([]) == []


def test_collect_chunks(spark):
    items = spark.createDataFrame([("k", "T", "A", "2020", "", "An abstract.")], "item_key string, title string, author_line string, year string, summary string, abstract string")
    pages = spark.createDataFrame([("k", 1, "# 1 One\n" + "Sentence here. " * 60), ("k", 2, "# References\n[1] x")], "item_key string, page int, text string")
    chunks = ck.collect_chunks(items, ck.sectionize(pages, "item_key"))
    levels = {(r.level, r.depth): r.n for r in chunks.groupBy("level", "depth").agg(F.count("*").alias("n")).collect()}
    assert levels[(0, 1)] == 2 and levels[(1, 0)] > 1 and levels[(1, 2)] == 1


def test_two_tier(spark):
    schema = "query_id int, chunk_id int, bm25 double"
    phrase = spark.createDataFrame([(1, 1, 2.0)], schema)
    wide = spark.createDataFrame([(1, 1, 3.0), (1, 2, 1.0), (2, 5, 1.0)], schema)
    got = {(r.query_id, r.chunk_id, r.tier) for r in rt.two_tier(phrase, wide).collect()}
    assert got == {(1, 1, 0), (1, 2, 1), (2, 5, 1)}


def test_fusion_is_monotone_in_rank(spark):
    route = spark.createDataFrame([(i, 1.0, i) for i in range(1, 6)], "chunk_id int, norm double, rank int")
    got = [r.chunk_id for r in rt.fuse({"keyword": route}).orderBy(F.desc("score")).collect()]
    assert got == [1, 2, 3, 4, 5]


def test_search(spark):
    chunks = spark.createDataFrame([(1, "a", 10, "body", "alpha beta"), (2, "a", 10, "body", "alpha beta gamma"), (3, "b", None, "review", "alpha"), (4, "c", None, "body", "nothing")],
                                   "chunk_id long, item_key string, parent_id long, kind string, text string")
    items = chunks.select("item_key").distinct().withColumn("year", F.when(F.col("item_key") == "b", "1990").otherwise("2020"))
    weights = spark.createDataFrame([("b", 3.0)], "item_key string, multiplier double")
    got = rows(search(chunks, None, items, weights, Search("alpha beta gamma")).select("item_key", "n_chunks"))
    assert got[0] == ("a", 1) and {g[0] for g in got} == {"a", "b"}
    kept = search(chunks, None, items, weights, Search("alpha beta"), keep=F.col("year") == "1990")
    assert [r.item_key for r in kept.collect()] == ["b"]
    assert search(chunks, None, items, weights, Search("42")).count() == 0


def test_resolve_merges(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("X", "Y"), ("Y", "X")], "old_key string, new_key string")
    keys = spark.createDataFrame([(k,) for k in "ABCXZ"], "key string")
    assert rows(rl.resolve_merges(edges, keys), "key") == [("A", "C", "ok"), ("B", "C", "ok"), ("C", "C", "ok"), ("X", None, "cycle"), ("Z", "Z", "ok")]


def test_long_chain(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(30)], "old_key string, new_key string")
    assert rl.resolve_merges(edges, spark.createDataFrame([("0",)], "key string")).first().root == "30"


def test_reference_status(spark):
    keys = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    items = spark.createDataFrame([("a",), ("m",)], "key string")
    merges = spark.createDataFrame([("b", "m"), ("c", "gone")], "old_key string, new_key string")
    dead = spark.createDataFrame([("d", "deleted")], "key string, kind string")
    got = {r.key: r.status for r in rl.reference_status(keys, items, merges, dead).collect()}
    assert got == {"a": "live", "b": "merged", "c": "merged-gone", "d": "deleted", "e": "unknown"}


def test_nearest_block(spark):
    blocks = spark.createDataFrame([(1, "big", 0.0, 0.0, 1.0, 1.0), (1, "small", 0.4, 0.4, 0.6, 0.6), (2, "far", 0.9, 0.9, 1.0, 1.0)], "page int, block_id string, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 1, 0.5, 0.5), (2, 1, 0.1, 0.1), (3, 2, 0.93, 0.97), (4, 2, 0.1, 0.1)], "point_id int, page int, x double, y double")
    assert rows(rl.nearest_block(points, blocks), "point_id") == [(1, "small"), (2, "big"), (3, "far")]


def test_edit_overlay_and_anchors(spark):
    pages = spark.createDataFrame([("k", 1, "one"), ("k", 2, "two")], "key string, page int, text string")
    text = files.render_pages(pages, "key")
    assert rows(files.parse_page_anchors(text, "key"), "page") == [("k", 1, "one"), ("k", 2, "two")]
    assert rows(files.split_form_feeds(spark.createDataFrame([("k", "a\fb")], "key string, text string"), "key"), "page") == [("k", 1, "a"), ("k", 2, "b")]


def test_drop_running_headers(spark):
    pages = spark.createDataFrame([("k", i, f"Journal {i}\nbody {'x' * i}\nmore {'y' * i}\nend {'z' * i}\nPage {i}") for i in range(1, 5)], "key string, page int, text string")
    got = [r.text for r in rl.drop_running_headers(pages, "key", "page").orderBy("page").collect()]
    assert got[0] == "body x\nmore y\nend z"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from([1, -1, 0]), max_size=30))
def test_floor_fold(spark, steps):
    now = 0
    for s in steps:
        now = max(0, now + s)
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate(steps)] or [("k", 0, 0)], "k string, i int, delta int")
    assert lg.folded_count(df, ["k"], ["i"]).first().value == now


def test_ledger(spark):
    led = spark.createDataFrame([(1, "2024-01-02", "q", "m", "effective", ["a", "a", "b"], None, None), (2, "2024-01-01", "test q", "m2", "unknown", ["a"], None, None)],
                                "id int, created_at string, asked string, method string, outcome string, item_keys array<string>, context string, reason string")
    got = rows(lg.ledger_weights(lg.explode_items(led)).select("item_key", "attempts", "effective"), "item_key")
    assert got == [("a", 2, 1), ("b", 1, 1)]
    assert [r.id for r in lg.related(led, ["q"], ["b"]).collect()] == [1]
    assert lg.without_tests(led, ["test"]).count() == 1
    assert lg.new_entries(led, led.where("id = 1")).count() == 1
    assert [r.id for r in lg.renumber(led, ["created_at"]).orderBy("created_at").collect()] == [1, 2]


def test_extraction(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert one(ex.extract_doi(F.lit("see doi: 10.1016/j.x.2020.01.002, and"))) == "10.1016/j.x.2020.01.002"
    assert tuple(one(ex.document_family(F.lit("Proceedings of the Conference")))) == ("conference", True)
    assert one(ex.table_usable(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"), F.lit("")))))
    assert one(ex.table_markdown(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"))))) == "| a | b |\n| --- | --- |\n| c |  |"


def test_table_markdown_of_many_rows(spark):
    rows = F.transform(F.sequence(F.lit(1), F.lit(12_000)), lambda i: F.array(i.cast("string")))
    lines = spark.range(1).select(ex.table_markdown(rows).alias("x")).first()[0].split("\n")
    assert len(lines) == 12_001 and lines[-1] == "| 12000 |"


def test_query_coverage_of_whole_items(spark, tmp_path):
    """The ninth word of an item and those after it count."""
    from marginalia.plans import queries as q

    spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh late later")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "aa"), (2, "late later")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.coverage, r.strong) for r in q.QUERIES["query_coverage"](spark, str(tmp_path)).collect()}
    assert got == {1: (round(4 / 73, 6), 1), 2: (round(41 / 73, 6), 2)}


def test_probe_match_of_cjk_titles(spark):
    """Windows of 8 characters match where the title holds a domain gram, else of 12 only; stride 1."""
    title = "基于深度学习的海洋能发电技术研究与展望"
    titles = spark.createDataFrame([("a", title), ("b", "甲乙丙丁戊己庚辛壬癸子丑寅卯"), ("c", "short four word title")], "key string, title string")
    texts = spark.createDataFrame([(1, "说到" + title[3:11] + "那篇"), (2, "看甲乙丙丁戊己庚辛吧"), (3, "看乙丙丁戊己庚辛壬癸子丑寅吧"), (4, "a Short four word title!"), (5, title[:7]), (6, None)], "id int, text string")
    domain = spark.createDataFrame([("海洋",)], "gram string")
    got = rl.probe_match(texts, titles, "id", "text", "key", "title", domain=domain).collect()
    assert {(r.id, r.key) for r in got} == {(1, "a"), (3, "b"), (4, "c")}


def test_captions(spark):
    pages = spark.createDataFrame([("k", 1, "Figure 1. A long caption that\ngoes on\ntext\nTable 2: Another one.\nFigure 3 ..... 12")], "key string, page int, text string")
    got = {(r.kind, r.label, r.caption) for r in ex.captions(pages, "key").collect()}
    assert got == {("figure", "Figure 1", "A long caption that goes on"), ("table", "Table 2", "Another one.")}


def test_library(spark):
    t = {
        "items": spark.createDataFrame([(1, "AAAA", 2), (2, "BBBB", 2), (3, "CCCC", 2)], "itemID long, key string, itemTypeID long"),
        "itemTypes": spark.createDataFrame([(2, "journalArticle")], "itemTypeID long, typeName string"),
        "itemAttachments": spark.createDataFrame([(3, 1, "application/pdf", 0, "storage:x.pdf")], "itemID long, parentItemID long, contentType string, linkMode int, path string"),
        "deletedItems": spark.createDataFrame([(2,)], "itemID long"),
        "itemData": spark.createDataFrame([(1, 1, 1)], "itemID long, fieldID long, valueID long"),
        "itemDataValues": spark.createDataFrame([(1, "A title")], "valueID long, value string"),
        "fields": spark.createDataFrame([(1, "title")], "fieldID long, fieldName string"),
        "creators": spark.createDataFrame([(1, "Jane", "Doe", 0), (2, None, "ACME", 1)], "creatorID long, firstName string, lastName string, fieldMode int"),
        "itemCreators": spark.createDataFrame([(1, 2, 1, 1), (1, 1, 1, 0)], "itemID long, creatorID long, creatorTypeID long, orderIndex int"),
        "creatorTypes": spark.createDataFrame([(1, "author")], "creatorTypeID long, creatorType string"),
        "collections": spark.createDataFrame([(1, "COL1", "Reading", None), (2, "COL2", "Empty", 1)], "collectionID long, key string, collectionName string, parentCollectionID long"),
        "collectionItems": spark.createDataFrame([(1, 1)], "collectionID long, itemID long"),
        "tags": spark.createDataFrame([(1, "x")], "tagID long, name string"),
        "itemTags": spark.createDataFrame([(1, 1)], "itemID long, tagID long"),
        "itemRelations": spark.createDataFrame([(1, 1, "http://z.org/users/1/items/OLDK"), (1, 1, "http://z.org/other/OLDK")], "itemID long, predicateID long, object string"),
        "relationPredicates": spark.createDataFrame([(1, "dc:replaces")], "predicateID long, predicate string"),
    }
    (item,) = library.load_items(t).collect()
    assert item.fields == {"title": "A title"} and [a["last"] for a in item.authors] == ["Doe", "ACME"] and item.collections == ["Reading"]
    assert rows(library.merge_relations(t)) == [("OLDK", "AAAA")]
    assert rows(library.collection_tree(t).select("key", "n_items"), "key") == [("COL1", 1), ("COL2", 0)]
    assert library.attachments(t).first().path == "storage/CCCC/x.pdf"


def test_upsert_keeps_schema_growth(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1)], "k int, v string, extra int")
    assert rows(rl.upsert(old, new, ["k"]).select("k", "v", "extra"), "k") == [(1, "a", None), (2, "c", 1)]


EVENTS = [("s", 1, "user", "ask one"), ("s", 2, "assistant", "reply"), ("s", 3, "tool", "kb"), ("s", 4, "user", "ask two"), ("s", 5, "assistant", "again"), ("t", 1, "assistant", "no question")]


def test_segments(spark):
    ev = spark.createDataFrame(EVENTS, "session string, seq long, kind string, text string")
    got = rows(sessions.segments(ev).select("session", "start_seq", "asked", "n_texts", "n_tools"), "start_seq")
    assert got == [("s", 1, "ask one", 1, 1), ("s", 4, "ask two", 1, 0)]
    saved = sessions.saved_offsets(sessions.segments(ev))
    assert rows(saved) == [("s", 4)]
    assert sessions.segments(ev, offsets=saved).count() == 0


def test_stream_segments(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps(dict(zip(("session", "seq", "kind", "text"), e))) for e in EVENTS))
    stream = spark.readStream.schema("session string, seq long, kind string, text string").json(str(src))
    q = sessions.stream_segments(stream).writeStream.format("memory").queryName("segs").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert rows(spark.table("segs")) == [("s", 1, "ask one", 1, 1)]


def test_stream_windows(spark, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parque[t]")
    q = sessions.windowed_counts(stream, size="6 hours").writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.table("wins").agg(F.sum("n")).first()[0] == 1000


def test_transcript(spark, tmp_path):
    lines = [{"session": "s", "seq": 1, "type": "user/message", "data": {"content": [{"type": "text", "text": "hi"}]}}, {"session": "s", "seq": 2, "type": "user/message", "data": {"source": {"kind": "system"}, "content": [{"type": "text", "text": "no"}]}}]
    p = tmp_path / "log.jsonl"
    p.write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    got = rows(sessions.flat_events(files.read_transcript(spark, str(p))))
    assert got == [("s", 1, "user", "hi")]


@pytest.mark.parametrize("mode,verdict,cache,parsed,expected", [("auto", "ok", 10, 99, "cache"), ("auto", "bad", 10, 99, "parsed"), ("auto", "unsure", 100, 99, "cache"), ("deep", "ok", 10, 99, "parsed"), ("off", "bad", 10, 99, "cache")])
def test_choose_text(spark, mode, verdict, cache, parsed, expected):
    assert spark.range(1).select(library.choose_text(F.lit(verdict), F.lit(cache), F.lit(parsed), mode)).first()[0] == expected


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sets(st.integers(0, 8), min_size=1, max_size=6), min_size=2, max_size=6), st.sampled_from([0.1, 0.3, 0.6, 1.0]))
def test_overlap_pairs(spark, groups, ratio):
    df = spark.createDataFrame([(i, x) for i, g in enumerate(groups) for x in g], "g int, m int")
    want = {(a, b, len(groups[a] & groups[b])) for a in range(len(groups)) for b in range(a + 1, len(groups)) if groups[a] & groups[b] and len(groups[a] & groups[b]) / min(len(groups[a]), len(groups[b])) >= ratio - 1e-12}
    assert {(r.a, r.b, r.shared) for r in rl.overlap_pairs(df, "g", "m", ratio).collect()} == want


@pytest.mark.parametrize("inline", [1, 3, 256])
def test_overlap_of_small_and_large_groups(spark, monkeypatch, inline):
    """Groups on both sides of MEMBERS_INLINE are linked alike, each pair once."""
    monkeypatch.setattr(rl, "MEMBERS_INLINE", inline)
    groups = [{1}, {1, 2}, {1, 2}, {1, 2, 3, 4}, {1, 2, 3, 4}, {3, 4, 5, 6, 7}, {8}]
    df = spark.createDataFrame([(i, x) for i, g in enumerate(groups) for x in g], "g int, m int")
    n = range(len(groups))
    linked = [(a, b, len(groups[a] & groups[b])) for a in n for b in n if a != b and len(groups[a] & groups[b]) / min(len(groups[a]), len(groups[b])) >= 0.6]
    assert sorted((r.a, r.b, r.shared) for r in rl.overlap_pairs(df, "g", "m").collect()) == [x for x in linked if x[0] < x[1]]
    want = [(a, groups.index(groups[a]), sum(x[0] == a for x in linked)) for a in n]
    assert sorted(tuple(r) for r in rl.overlap_classes(df, "g", "m").collect()) == want


@pytest.mark.parametrize("bits, members", [(0, 12), (1024, 12), (1024, 64), (1024, 150)])
def test_overlaps_as_bits_and_by_rare_members(spark, monkeypatch, bits, members):
    """Few members that most groups share: compared as bits in blocks, with the same pairs as by rare members."""
    import random

    for name, value in (("MEMBERS_AS_BITS", bits), ("GROUPS_A_BLOCK", 7), ("PAIRS_AT_ONCE", 16)):
        monkeypatch.setattr(rl, name, value)
    rnd = random.Random(members)
    groups = {f"g{i}": set(rnd.sample(range(members), rnd.randint(1, members))) for i in range(40)} | {"all": set(range(members))}
    df = spark.createDataFrame([(g, f"m{x}") for g, xs in groups.items() for x in [*xs, min(xs)]] + [(None, "m1"), ("g0", None)], "g string, m string")
    found = rl.overlap_pairs(df, "g", "m")
    assert ("MapInArrow" in found._jdf.queryExecution().toString()) == (bits > 0)
    want = sorted((a, b, k, k / min(len(groups[a]), len(groups[b]))) for a in groups for b in groups if a < b and (k := len(groups[a] & groups[b])) / min(len(groups[a]), len(groups[b])) >= 0.6)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert sum(r.n_links for r in rl.overlap_classes(df, "g", "m").collect()) == 2 * len(want)
    assert rl.overlap_pairs(df.where("false"), "g", "m").count() == 0


@pytest.mark.parametrize(("size", "rounds"), [(1 << 30, 0), (8000, 4), (2500, 11)])
def test_overlaps_in_rounds(spark, monkeypatch, size, rounds):
    """Places go in rounds of a bounded size, each stored before the next, with the same pairs; larger groups beside them."""
    import random

    stored, kept = [], rl.kept
    for name, value in (("MEMBERS_AS_BITS", 0), ("MEMBERS_INLINE", 12), ("ROUND_BYTES", size), ("kept", lambda df: (stored.append(df.columns), kept(df))[1])):
        monkeypatch.setattr(rl, name, value)
    rnd = random.Random(7)
    groups = [set(rnd.sample(range(15), rnd.randint(5, 12))) for _ in range(40)] + [set(range(14)), set(range(15))]
    df = spark.createDataFrame([(i, x) for i, g in enumerate(groups) for x in g], "g int, m int")
    want = sorted((a, b, k) for a in range(42) for b in range(a + 1, 42) if (k := len(groups[a] & groups[b])) / min(len(groups[a]), len(groups[b])) >= 0.6)
    assert sorted((r.a, r.b, r.shared) for r in rl.overlap_pairs(df, "g", "m").collect()) == want
    assert -(-sum(8 * len(g) ** 2 for g in groups[:40]) // size) in (rounds, 1) and stored.count(["s", "t", "ns", "nt", "shared"]) == rounds


def test_stored_tables_leave_no_shuffle_files(spark):
    """What is stored needs its shuffle no more, and the session's setting is as it was."""
    spark.conf.unset(rl.CLEANUP)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    assert rl.kept(df).count() == 7 and spark.conf.get(rl.CLEANUP, None) in (None, "false")
    rl.kept(df)
    assert tracker.shuffleStatuses().size() <= before + 1


def test_ledger_edits(spark):
    led = spark.createDataFrame([(1, "2024", "q", "effective", ["a"], None), (2, "2024", "r", "partial", [], ["{}"])], "id long, created_at string, asked string, outcome string, item_keys array<string>, history array<string>")
    edited = lg.update_entries(led, spark.createDataFrame([(2, "ineffective")], "id long, outcome string"), "2025")
    got = {r.id: (r.asked, r.outcome, len(r.history)) for r in edited.collect()}
    assert got == {1: ("q", "effective", 0), 2: ("r", "ineffective", 2)}
    assert json.loads([r.history for r in edited.collect() if r.id == 2][0][1]) == {"at": "2025", "outcome": "partial"}
    assert [(r.id, r.asked) for r in lg.delete_entries(led, spark.createDataFrame([(1,)], "id long")).collect()] == [(1, "r")]
    assert {(r.id, r.n_items, r.n_edits) for r in lg.entry_views(edited).collect()} == {(1, 1, 0), (2, 0, 2)}


def test_titles_and_json(spark):
    from marginalia.functions import scalars as sc
    from marginalia.plans.search import any_known

    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert one(sc.clean_title(F.lit("Deep Learning Methods | IEEE Xplore"))) == "Deep Learning Methods" and one(sc.clean_title(F.lit("某某技术发展现状与展望-某某新闻网"))) == "某某技术发展现状与展望" and one(sc.clean_title(F.lit("A title | Some Site"))) == "A title | Some Site"
    assert one(sc.title_weight(F.lit("深a"))) == 3
    assert one(sc.recover_json(F.lit('```json\n{"a": 1}\n``` ok'))) == '{"a": 1}'
    assert one(sc.recover_json(F.lit("none"))) is None
    df = spark.createDataFrame([("学", 3)], "term string, df long")
    assert any_known([("学", 1.0)], df) and not any_known([("习", 1.0)], df) and any_known([("ab", 4.0)], df) and not any_known([], df)


def test_keyword_recall(spark):
    """Phrases first; by single characters where fewer than five chunks hold the phrase; bm25 breaks ties of coverage."""
    from marginalia.plans.search import Search, diagnostics, keyword_route, phrase_terms, search, tokenize, wide_terms

    assert tokenize('机器 "多神经 网络" foo-bar ｘ1') == [("cjk", "机"), ("cjk", "器"), ("quoted", "多神经 网络"), ("word", "foo-bar"), ("word", "x1")]
    assert phrase_terms("机器学习 deep-learning") == [["机", "器", "学", "习"], ["deep", "learning"]]
    assert wide_terms('"机器" a "c d"') == ([["机"], ["器"], ["a"], ["c", "d"]], [[0, 1], [2], [3]])
    texts = ["机器学习的方法", "学习机器的方法", "机器 学习", "the deep-learning way", "deep sea learning", "deep learning deep learning", "器具"]
    chunks = spark.createDataFrame([(i, f"k{i}", None, "body", t, 3 if i == 2 else 0, 0 if i == 5 else 1) for i, t in enumerate(texts)], "chunk_id long, item_key string, parent_id long, kind string, text string, depth int, level int")
    found = {r.chunk_id: r for r in keyword_route(chunks, "机器学习").collect()}
    assert set(found) == {0, 1, 2, 6} and found[0].rank == 1 and found[0].bm25 > 0
    assert [r.chunk_id for r in keyword_route(chunks, "deep-learning").orderBy("rank").collect()] == [3]
    assert keyword_route(chunks, "42 !") is None
    none = spark.createDataFrame([], "item_key string, multiplier double")
    parents = spark.createDataFrame([], "parent_id long, text string")
    got = {r.item_key: r for r in search(chunks, None, chunks.select("item_key"), none, Search("机器学习"), parents=parents).collect()}
    assert set(got) == {"k0", "k1", "k6"} and got["k0"].snippets and not got["k0"].truncated
    assert "k2" in {r.item_key for r in search(chunks, None, chunks.select("item_key"), none, Search("机器学习", whole_documents=True)).collect()}
    assert diagnostics(chunks, Search("机器学习"))["phrase_hits"] == 2


def test_end_mark_before_a_question_is_ignored(spark):
    ev = spark.createDataFrame([("s", 1, "end", ""), ("s", 2, "user", "q"), ("s", 3, "assistant", "a"), ("s", 4, "end", ""), ("s", 5, "user", "late")], "session string, seq long, kind string, text string")
    assert rows(sessions.segments(ev).select("start_seq", "asked", "n_texts")) == [(2, "q", 1)]


def test_long_merge_chains(spark):
    edges = spark.createDataFrame([(f"k{i:04}", f"k{i + 1:04}") for i in range(150)] + [("a", "b"), ("b", "a")], "old_key string, new_key string")
    got = {r.key: (r.root, r.status) for r in rl.resolve_merges(edges, spark.createDataFrame([("k0000",), ("a",), ("z",)], "key string")).collect()}
    assert got == {"k0000": ("k0150", "ok"), "a": (None, "cycle"), "z": ("z", "ok")}


def test_parent_for_offset_hot_key_ties_and_nulls(spark):
    import random

    rng = random.Random(5)
    parts = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(400), i) for i in range(300)] + [("hot", None, 900), (None, 3, 901)]
    kids = [("hot" if i % 2 else f"k{i % 9}", rng.choice([None, *range(-5, 420)]), i) for i in range(500)] + [(None, 7, 950), ("alone", 7, 951)]
    want = {i: max(((s, p) for k2, s, p in parts if k is not None and k2 == k and s is not None and at is not None and s <= at), default=(0, None))[1] for k, at, i in kids}
    c = spark.createDataFrame(kids, "sec string, offset int, side int")
    p = spark.createDataFrame(parts, "sec string, start int, part_id int")
    for ranges in (200, 3):
        out = rl.parent_for_offset(c, p, "sec", ranges)
        assert out.columns == ["sec", "offset", "side", "parent_part"]
        assert {r.side: r.parent_part for r in out.collect()} == want
    assert [r.parent_part for r in rl.parent_for_offset(c, p.limit(0), "sec").collect()] == [None] * len(kids)
    assert rl.parent_for_offset(c.limit(0), p, "sec").count() == 0


def test_subtree_texts(spark):
    rows = [("d", 0, 1, " A "), ("d", 1, 2, ""), ("d", 2, 3, "B"), ("d", 3, 2, "CC"), ("d", 4, 1, None), ("e", 0, 2, "x")]
    got = {(r.k, r.seq): (r.text, [tuple(o) for o in r.offsets]) for r in ck.subtree_texts(spark.createDataFrame(rows, "k string, seq int, level int, text string"), "k").collect()}
    assert got[("d", 0)] == ("A\n\nB\n\nCC", [(0, 0), (1, 1), (2, 3), (3, 6)])
    assert got[("d", 1)] == ("B", [(1, 0), (2, 0)])
    assert got[("d", 4)] == ("", [(4, 0)]) and got[("e", 0)] == ("x", [(0, 0)])


def test_facet_keys(spark):
    rows = [("a", "Thesis", "EI，CSCD", "TP391.9; O1"), ("b", "thesis", "EIA", "tp3"), ("c", None, None, None)]
    x = spark.createDataFrame(rows, "item_key string, source_kind string, publication_tag string, clc string")
    keys = lambda **k: {r.item_key for r in vw.facet_keys(x, **k).collect()}
    assert keys(kind="学位论文", labels={"thesis": "学位论文"}) == {"a", "b"}
    assert keys(tag="ei") == {"a"} and keys(codes="TP3") == {"a", "b"} and keys(codes="tp39, o") == {"a"} and keys() == {"a", "b", "c"}
    assert vw.facet_keys(x.drop("clc"), codes="TP").count() == 0 and vw.facet_keys(x.drop("clc"), tag="EI").count() == 1


def test_extras_vectors_and_ledger_upkeep(spark, tmp_path):
    v = spark.createDataFrame([(1, "m"), (2, "n")], "chunk_id int, model string")
    assert rl.current_vectors(v, "m", "n").count() == 1 and rl.current_vectors(v, "m", None).count() == rl.current_vectors(v, "m", "m").count() == 2
    led = spark.createDataFrame([("q", "m", "effective"), ("q", None, "partial")], "asked string, method string, outcome string")
    lg.export_entries(led, str(tmp_path / "out"))
    back = spark.read.schema(led.schema).json(str(tmp_path / "out"))
    assert back.count() == 2 and lg.new_entries(back, led).count() == 0
