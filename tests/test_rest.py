"""Operators that no query over the given tables can show: rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import scalars as sc
from marginalia.functions import text as tx
from marginalia.operators import ledger as lg
from marginalia.operators import relational as rl
from marginalia.operators import retrieval as rt
from marginalia.operators import views as vw
from marginalia.sources import files, library
from marginalia.streaming import sessions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    cases = [
        (sc.short_title(F.lit("A title: and more")), "A title and more"), (sc.short_title(F.lit("word " * 20)), "word word word word word word word word…"), (sc.short_title(F.lit(None).cast("string")), "(无标题)"),
        (sc.short_title(F.lit("深度学习方法研究：一个综述")), "深度学习方法研究"), (sc.short_title(F.lit("短题：一个综述")), "短题：一个综述"), (sc.short_title(F.lit("电" * 50)), "电" * 40 + "…"), (sc.short_title(F.lit("a" * 50)), "a" * 40 + "…"),
        (sc.short_title(F.lit("Some Long Words, Supercapattery Energy, Storage")), "Some Long Words, Supercapattery Energy…"), (sc.clean_name(F.lit(' .a<b>:c|  d?*"\\/. ')), "abc d"), (sc.short_author(F.lit("Yucheng Jiao")), "Jiao Y."),
        (sc.short_author(F.lit("Du Changping")), "Du C."), (sc.short_author(F.lit("Anjana P. M")), "M A.P."), (sc.short_author(F.lit("张 三")), "张 三"), (sc.short_author(F.lit("ACME")), "ACME"), (sc.short_author(F.lit(None).cast("string")), ""),
        (sc.western_short(F.lit("Doe"), F.lit("jane q.r")), "Doe J.Q.R."), (sc.western_short(F.lit("ACME"), F.lit(None).cast("string")), "ACME"), (sc.western_short(F.lit(""), F.lit("Ann")), "A."),
        (sc.human_ref(F.lit("A title"), F.lit("Yucheng Jiao"), F.lit(2020)), "Jiao Y. 2020 · A title"), (sc.human_ref(F.lit("A title"), F.lit(None).cast("string"), F.lit(None).cast("string")), "A title"),
        (sc.human_label(F.lit(""), F.lit("王五"), F.lit(" "), F.lit("KEY1")), "王五 · (无标题)  [KEY1]"),
        (sc.cli_score(F.lit(1), F.lit(0.5), F.lit(2), F.lit(3)), 10.5), (sc.title_weight(F.lit("中文ab")), 6), (sc.title_weight(F.lit("\u3400\uf900")), 2),
        (tx.embedded_images(F.lit("<img data-attachment-key='A'><img data-attachment-key='B'>")), 2), (tx.strip_jats(F.lit("<jats:p>a &lt; b  &amp;amp; c</jats:p>")), "a < b &amp; c"),
        (sessions.head_tail(F.lit("abcdefghij"), 4), "ab\n\n…\n\nij"), (sessions.head_tail(F.lit("abc"), 4), "abc"), (rl.interval_iou([F.lit(x) for x in (0.0, 0.0, 2.0, 2.0)], [F.lit(x) for x in (1.0, 1.0, 3.0, 3.0)]), 1 / 7),
        (rl.interval_iou([F.lit(0.0)] * 4, [F.lit(0.0)] * 4), 0.0),
    ]
    for column, want in cases:
        got = one(spark, column)
        assert got == want or abs(got - want) < 1e-12


def test_views(spark):
    chunks = spark.createDataFrame([("a", 1, 0, "first page text"), ("a", 2, 1, "here the sample stands, and goes on"), ("a", 3, 2, "the sample stands again"), ("b", 1, 0, "of b")], "item_key string, page int, seq int, text string")
    samples = spark.createDataFrame([("s1", "a", "the sample stands"), ("s2", "b", "nowhere")], "sample_id string, item_key string, sample string")
    assert [tuple(r) for r in vw.sample_page(samples, chunks).collect()] == [("s1", 2)]
    health = spark.createDataFrame([("a", "bad", "few words"), ("c", "ok", "")], "item_key string, verdict string, reasons string")
    detail = {r.item_key: r.samples for r in vw.health_detail(health, chunks, 2, 5).collect()}
    assert [s.text for s in detail["a"]] == ["first", "here "] and detail["c"] is None
    items = spark.createDataFrame([("x", "webpage", 1), ("y", "journalArticle", 1), ("z", "webpage", 0)], "item_key string, item_type string, n_pdfs int")
    assert [r.item_key for r in vw.type_fixes(items, ["journalArticle"]).collect()] == ["x"]


def test_library_notes_annotations_and_the_nested_item(spark):
    items = [(1, "AAAA", 2), (3, "CCCC", 2), (4, "NOTE", 3), (5, "LONE", 3), (6, "ANNA", 4), (7, "ANNB", 4), (8, "GONE", 3)]
    t = {
        "items": spark.createDataFrame(items, "itemID long, key string, itemTypeID long"), "itemTypes": spark.createDataFrame([(2, "journalArticle")], "itemTypeID long, typeName string"),
        "itemAttachments": spark.createDataFrame([(3, 1, "application/pdf", 0, "storage:x.pdf")], "itemID long, parentItemID long, contentType string, linkMode int, path string"),
        "itemNotes": spark.createDataFrame([(4, 1, "N", "<p>a <b>note</b></p><img data-attachment-key='K'/>"), (5, None, "L", "<p>alone</p>"), (8, 1, "D", "x")], "itemID long, parentItemID long, title string, note string"),
        "itemAnnotations": spark.createDataFrame([(6, 3, "10", "later", None), (7, 3, "2", "sooner", "why")], "itemID long, parentItemID long, pageLabel string, text string, comment string"),
        "deletedItems": spark.createDataFrame([(8,)], "itemID long"), "itemData": spark.createDataFrame([(1, 1, 1), (3, 1, 2)], "itemID long, fieldID long, valueID long"),
        "itemDataValues": spark.createDataFrame([(1, "A title"), (2, "Full Text")], "valueID long, value string"), "fields": spark.createDataFrame([(1, "title")], "fieldID long, fieldName string"),
        "creators": spark.createDataFrame([], "creatorID long, firstName string, lastName string, fieldMode int"), "itemCreators": spark.createDataFrame([], "itemID long, creatorID long, creatorTypeID long, orderIndex int"),
        "creatorTypes": spark.createDataFrame([], "creatorTypeID long, creatorType string"), "collections": spark.createDataFrame([], "collectionID long, key string, collectionName string, parentCollectionID long"),
        "collectionItems": spark.createDataFrame([], "collectionID long, itemID long"), "tags": spark.createDataFrame([], "tagID long, name string"), "itemTags": spark.createDataFrame([], "itemID long, tagID long"),
        "itemRelations": spark.createDataFrame([(1, 1, "http://z.org/users/1/items/OLDK"), (1, 1, "http://z.org/other/OLDK"), (99, 1, "http://z.org/users/1/items/LOST"), (1, 2, "http://z.org/users/1/items/X")], "itemID long, predicateID long, object string"),
        "relationPredicates": spark.createDataFrame([(1, "dc:replaces"), (2, "dc:relation")], "predicateID long, predicate string"),
    }
    (item,) = library.load_items(t).collect()
    assert [(a.id, a.title, a.path) for a in item.attachments] == [(3, "Full Text", "storage/CCCC/x.pdf")]
    assert [(a.page, a.text, a.comment) for a in item.annotations] == [("2", "sooner", "why"), ("10", "later", None)]
    assert [(n.id, n.title, n.markdown) for n in item.notes] == [(4, "N", "a **note**")]
    assert {r.itemID: r.images for r in library.notes(t).collect()} == {4: 1, 5: 0}
    assert tuple(library.merge_counts(t).first()) == (3, 1, 2)


def test_tables_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "n int, p string")
    files.write_table(df, str(tmp_path / "t"), ["p"])
    files.write_table(spark.createDataFrame([(9, "a")], "n int, p string"), str(tmp_path / "t"), ["p"])
    assert sorted(map(tuple, files.read_table(spark, str(tmp_path / "t")).select("n", "p").collect())) == [(2, "b"), (9, "a")]
    (tmp_path / "x.csv").write_text("1,2\n")
    assert tuple(files.read_table(spark, str(tmp_path / "x.csv"), "csv", "a int, b int").first()) == (1, 2)
    files.write_bucketed(df, "bucketed_rest", "n", 4)
    plan = spark.table("bucketed_rest").join(spark.table("bucketed_rest").withColumnRenamed("p", "q").hint("merge"), "n")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE bucketed_rest")


@pytest.mark.parametrize("phrases", [[["the", "the"]], [["a", "b", "a"], ["b"]], [["x"]], [["a", "a", "a"]]])
def test_phrases_in_an_index_and_in_texts(spark, phrases):
    """Both ways of counting, and a plain one; a token that repeats a lot is linear, not quadratic."""
    texts = [(1, "the the the a b a b a"), (2, "a a a a"), (3, ""), (4, None), (5, "b, the; The"), (6, "the " * 20_000)]
    docs = spark.createDataFrame(texts, "chunk_id int, text string")
    names = [f"tf{i}" for i in range(len(phrases))]
    want = {}
    for i, t in texts:
        w = (t or "").lower().replace(",", "").replace(";", "").split()
        want[i] = tuple(sum(w[k : k + len(p)] == p for k in range(len(w))) for p in phrases)
    inside = {r.chunk_id: tuple(r[n] for n in names) for r in rt.counted_in_texts(docs, phrases).collect()}
    assert inside == want
    index = {r.chunk_id: tuple(r[n] for n in names) for r in rt.counted_in_index(rt.postings(docs), phrases).collect()}
    assert index == {k: v for k, v in want.items() if k in index} and all(k in index for k, v in want.items() if any(v))


def test_spread(spark):
    few, many = spark.range(100).coalesce(1), spark.range(100).repartition(9)
    assert rl.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rl.spread(many) is many


def test_clean_ledger_undoes_weights(spark):
    led = spark.createDataFrame([(1, "a real one", "", "effective", ["x"]), (2, "[test] q", "", "effective", ["x", "y", "x"]), (3, "other", "tags,[test]", "ineffective", ["z"]), (4, "last", None, "partial", ["z"])], "id long, asked string, tags string, outcome string, item_keys array<string>")
    weights = spark.createDataFrame([("x", 2, 2, 0, 0, 0, 0.0), ("y", 1, 1, 0, 0, 0, 0.0), ("z", 0, 0, 0, 1, 0, 0.0), ("p", 0, 0, 0, 0, 1, 0.0)], "item_key string, attempts long, effective long, ineffective long, partial long, pinned int, manual double")
    kept, after = lg.clean_ledger(led, weights, ["[test]"], ["id"])
    assert sorted((r.id, r.asked) for r in kept.collect()) == [(1, "a real one"), (2, "last")]
    assert {r.item_key: (r.attempts, r.effective, r.ineffective, r.partial) for r in after.collect()} == {"x": (1, 1, 0, 0), "z": (0, 0, 0, 1), "p": (0, 0, 0, 0)}


def test_chunks_keep_few_rows_as_python_objects():
    """A batch of texts is worked through in slices, so its rows are never all Python objects at once."""
    import pyarrow as pa

    from marginalia.operators import chunking as ck

    alive = [0, 0]

    class Piece(dict):
        def __init__(self, text):
            super().__init__(offset=0, text=text)
            alive[0] += 1
            alive[1] = max(alive)

        def __del__(self):
            alive[0] -= 1

    kind = pa.list_(pa.struct([("offset", pa.int32()), ("text", pa.string())]))
    rows = pa.array([str(i) for i in range(1000)] + [None])
    out = ck._sliced(lambda t: [Piece(t)], rows, kind, 7)
    assert out.to_pylist() == [[{"offset": 0, "text": x}] for x in rows.to_pylist()] and alive[1] <= 14
    assert ck._sliced(lambda t: [Piece(t)], rows.slice(0, 0), kind).to_pylist() == []


@pytest.mark.parametrize("size", [0, 64 << 20])
def test_probes_broadcast_or_joined(spark, monkeypatch, size):
    """Small probes are broadcast before the texts' windows are shuffled; the hits are the same either way."""
    monkeypatch.setattr(rl, "PROBE_BYTES", size)
    docs = spark.createDataFrame([(1, "one two three four five one two three four"), (2, "nothing of it at all"), (3, None)], "d int, x string")
    titles = spark.createDataFrame([("p", "two three four five"), ("q", "one two three four")], "t string, y string")
    found = rl.probe_match(docs, titles, "d", "x", "t", "y")
    assert sorted((r.d, r.t, r.hits, r.r) for r in found.collect()) == [(1, "p", 1, 1), (1, "q", 1, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("LeftSemi" in plan) == (size > 0)


def test_query_coverage_in_portions(spark, monkeypatch):
    """A task's sums stay near TASK_SUMS: more chunks make more tasks."""
    docs = spark.createDataFrame([(i, "alpha beta" if i % 2 else "beta") for i in range(40)], "chunk_id int, text string").coalesce(1)
    asks = spark.createDataFrame([("q", "alpha beta")], "query_id string, query string")
    monkeypatch.setattr(rt, "TASK_SUMS", 8)
    found = rt.query_coverage(docs, asks)
    assert {(r.chunk_id, r.strong) for r in found.collect()} == {(i, 1 + i % 2) for i in range(40)}
    assert "Repartition 5" in found._jdf.queryExecution().optimizedPlan().toString()
