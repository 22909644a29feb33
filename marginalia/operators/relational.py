"""Keyed merges, reconciliation, graph and overlap operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.text import edge_form


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key; missing columns become null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_keep_named(old: DataFrame, new: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Upsert in which blank names never overwrite stored ones."""
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: F.coalesce(F.nullif(F.trim(F.col(f"n.{c}")), F.lit("")), F.col(f"o.{c}")) if c in names else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), *[pick(c).alias(c) for c in old.columns if c != key])


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """First seen wins: rows of ``new`` with a known key are dropped, repeated keys keep the earliest."""
    w = Window.partitionBy(key).orderBy(order)
    first = new.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return old.unionByName(first.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def missing(left: DataFrame, right: DataFrame, on: list[str] | str) -> DataFrame:
    return left.join(right, on, "left_anti")


def present(left: DataFrame, right: DataFrame, on: list[str] | str) -> DataFrame:
    return left.join(right, on, "left_semi")


def reconcile(known: DataFrame, live: DataFrame, trashed: DataFrame, archived: DataFrame, key: str) -> DataFrame:
    """(key, action): keep, archive (in the trash), delete (gone), restore (back from the archive) or add."""
    flags = [df.select(key).distinct().withColumn(name, F.lit(True)) for name, df in (("k", known), ("l", live), ("t", trashed), ("a", archived))]
    out = flags[0]
    for f in flags[1:]:
        out = out.join(f, key, "full_outer")
    k, live_, t, a = (F.coalesce(F.col(c), F.lit(False)) for c in "klta")
    action = (
        F.when(k & live_, "keep").when(k & t, "archive").when(k, "delete").when(live_ & a, "restore").when(live_, "add").when(a & ~t, "purge").otherwise("none")
    )
    return out.select(key, action.alias("action"))


def changes(known: DataFrame, current: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """(key, change): new, gone, same, or ``changed:`` and the first column that differs, null-safe."""
    o, n = known.alias("o"), current.alias("n")
    change = F.when(F.col(f"o.{key}").isNull(), "new").when(F.col(f"n.{key}").isNull(), "gone")
    for c in compare:
        change = change.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), f"changed:{c}")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), change.otherwise("same").alias("change"))


SHARED = "spark.checkpoint.dir"
#: With it, shuffle files go when the table that they were for is written, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """A table written to the folder that spark.checkpoint.dir names, and read back: computed once, lineage ends
    here, and so do the shuffle files behind it. Only a local session may run without that setting."""
    spark = df.sparkSession
    folder = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SHARED} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set(SHARED, folder)
    path = f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/kept-{uuid.uuid4().hex[:12]}"
    held = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, held) if held else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than the cluster has cores dealt out evenly, for work that costs more than a shuffle
    of the rows; any larger table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def resolve_merges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, root, status): follow old_key to new_key. status is ok, or cycle where the chain returns.

    Pointer jumping: each round doubles the length that is followed, by one equi-join. A chain has no
    more links than there are edges, so a key that still has a successor after as many lies on a cycle or leads to one.
    """
    step = edges.groupBy("old_key").agg(F.min("new_key").alias("new_key"))
    jump = step
    for _ in range(max(1, step.count().bit_length())):
        nxt = jump.select(F.col("old_key").alias("new_key"), F.col("new_key").alias("next"))
        jump = kept(jump.join(nxt, "new_key", "left").select("old_key", F.coalesce("next", "new_key").alias("new_key")))
    again = step.select(F.col("old_key").alias("new_key"), F.lit(True).alias("more"))
    out = keys.select("key").join(jump.withColumnRenamed("old_key", "key"), "key", "left").join(again, "new_key", "left")
    return out.select("key", F.when(F.col("more"), F.lit(None).cast("string")).otherwise(F.coalesce("new_key", "key")).alias("root"), F.when(F.col("more"), "cycle").otherwise("ok").alias("status"))


def reference_status(keys: DataFrame, items: DataFrame, merges: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(key, status, target): live, merged (and live), merged-gone, deleted, archived or unknown."""
    roots = resolve_merges(merges, keys)
    have = items.select(F.col("key").alias("root"), F.lit(True).alias("__live")).distinct()
    dead = tombstones.select("key", "kind").dropDuplicates(["key"])
    j = roots.join(have, "root", "left").join(dead, "key", "left")
    live, moved = F.coalesce("__live", F.lit(False)), F.col("root") != F.col("key")
    status = F.when(F.col("status") == "cycle", "unknown").when(live & ~moved, "live").when(live, "merged").when(F.coalesce(moved, F.lit(False)), "merged-gone").when(F.col("kind") == "archived", "archived").when(F.col("kind").isNotNull(), "deleted").otherwise("unknown")
    return j.select("key", status.alias("status"), F.when(live, F.col("root")).alias("target"))


#: Members of a group that are compared at once, and up to how many a group's members travel with each of its places.
MEMBERS_A_PART, MEMBERS_INLINE = 10_000, 256
#: About how many bytes of members the places carry in one round.
ROUND_BYTES = 8 << 30
#: Up to how many different members groups may be compared as bits, how many groups make a block, and how many pairs are
#: compared at once; a place that two groups share costs about as much as so many pairs of words of 64 bits.
MEMBERS_AS_BITS, GROUPS_A_BLOCK, PAIRS_AT_ONCE, PLACE_COST = 1024, 8192, 1 << 19, 100


def _compare(min_ratio: float, words: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (same, one, other) of two blocks of groups (g, n, bits) to the pairs of groups that overlap."""
    at_once = PAIRS_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        # the least number of shared members that makes the ratio, as it is divided; it never falls with n
        least = np.array([next(k for k in range(max(1, math.ceil(n * min_ratio) - 1), n + 2) if k > n or k / n >= min_ratio) for n in range(1, 64 * words + 1)], dtype=np.uint16)

        def block(rows: pa.StructArray) -> tuple:
            g, n, bits = rows.flatten()
            return g, n, least[n.to_numpy(zero_copy_only=False) - 1], bits.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)

        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column("same")[row].as_py()
                (ga, na, need_a, a), (gb, nb, need_b, b) = (block(batch.column(c)[row].values) for c in ("one", "other"))
                step = max(1, at_once // len(b))
                for low in range(0, len(a), step):
                    x = a[low : low + step]
                    shared = np.bitwise_count(x[:, :1] & b[:, 0])
                    if words > 1:
                        shared = shared.astype(np.uint16)
                        for w in range(1, words):
                            shared += np.bitwise_count(x[:, w : w + 1] & b[:, w])
                    near = shared >= np.minimum(need_a[low : low + step, None], need_b)
                    if same:
                        near &= np.arange(len(b)) > np.arange(low, low + len(x))[:, None]
                    i, j = np.nonzero(near)
                    if len(i):
                        at, to = pa.array(i + low), pa.array(j)
                        yield pa.RecordBatch.from_arrays([ga.take(at), gb.take(to), na.take(at), nb.take(to), pa.array(shared[i, j].astype(np.int64))], names=names)

    return run


def _dense_overlaps(m: DataFrame, df: DataFrame, n_members: int, n_groups: int, min_ratio: float) -> DataFrame:
    """_overlaps where nearly all groups share members: each group's members are bits, and every two blocks of groups meet in one row."""
    words = -(-n_members // 64)
    numbered = F.broadcast(df.select("m", (F.row_number().over(Window.orderBy("m")) - 1).alias("at")))
    placed = m.join(numbered, "m").select("g", (F.col("at") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, at % 64)").alias("bit"))
    bits = F.array(*[F.coalesce(F.bit_or(F.when(F.col("w") == w, F.col("bit"))), F.lit(0).cast("long")) for w in range(words)])
    groups = placed.groupBy("g").agg(F.count("*").alias("n"), bits.alias("bits"))
    blocks = max(-(-n_groups // GROUPS_A_BLOCK), min(-(-n_groups // 1024), math.isqrt(32 * m.sparkSession.sparkContext.defaultParallelism)))
    dealt = kept(groups.groupBy(F.pmod(F.xxhash64("g"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("g", "n", "bits")).alias("rows")))
    cells = min(blocks * (blocks + 1) // 2, 10_000)
    one = dealt.select(F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(blocks - 1).cast("long"))).alias("j"), F.col("rows").alias("one")).repartition(cells, "i", "j")
    other = dealt.select(F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"), F.col("rows").alias("other")).repartition(cells, "i", "j")
    kind = m.schema["g"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, na long, nb long, shared long"
    met = one.join(other.hint("merge"), ["i", "j"]).select((F.col("i") == F.col("j")).alias("same"), "one", "other").mapInArrow(_compare(min_ratio, words, ["a", "b", "na", "nb", "shared"]), schema)
    first = F.expr("na < nb OR na = nb AND a < b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return met.select(pick("a", "b").alias("s"), pick("b", "a").alias("t"), pick("na", "nb").alias("ns"), pick("nb", "na").alias("nt"), "shared")


def _overlaps(m: DataFrame, min_ratio: float) -> DataFrame:
    """(s, t, ns, nt, shared): overlap_pairs of distinct (g, m), the smaller group as s (of equal ones that of the smaller key).

    m is read several times, so it should be stored."""
    df = m.groupBy("m").agg(F.count("*").alias("df"))
    members, meets = df.agg(F.count("*"), F.sum(F.col("df").cast("double") * F.col("df"))).first()
    if 0 < members <= MEMBERS_AS_BITS:
        n_groups = m.select("g").distinct().count()
        if PLACE_COST * meets >= n_groups * n_groups * -(-members // 64):
            return _dense_overlaps(m, df, members, n_groups, min_ratio)
    of = Window.partitionBy("g")
    ranked = m.join(df, "m").withColumns({"n": F.count("*").over(of), "r": F.row_number().over(of.orderBy("df", "m"))})
    need = F.ceil(F.col("ns") * min_ratio - 1e-9)
    order = F.expr("s <> t AND (ns < nt OR ns = nt AND s < t)")
    # a place carries what follows it; the first one that two groups share counts most, others that pass are the same pair
    whole = kept(ranked.where(F.col("n") <= MEMBERS_INLINE).groupBy("g", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "m"))), lambda x: x["m"]).alias("ms")))
    largest, carried = m.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum(F.when(F.col("n") <= MEMBERS_INLINE, 8 * F.col("n") * F.col("n")))).first()
    largest, rounds = largest or 0, max(1, -(-(carried or 0) // ROUND_BYTES))
    both = 1 + F.size(F.array_intersect("__s", "__t"))

    def meeting(k: int) -> DataFrame:
        """The pairs that meet at the members of one round, each with the most that one place counts."""
        at = F.transform("ms", lambda x, i: F.struct((i + 1).alias("r"), x.alias("m")))
        mine = F.filter(at, lambda x: F.pmod(F.xxhash64(x["m"]), F.lit(rounds)) == k) if rounds > 1 else at
        places = whole.select("g", "n", "ms", F.inline(mine)).select("g", "n", "r", "m", F.slice("ms", F.col("r") + 1, F.col("n").cast("int")).alias("rest"))
        early = places.select(F.col("g").alias("s"), F.col("n").alias("ns"), F.col("r").alias("rs"), "m", F.col("rest").alias("__s")).where(F.col("ns") - F.col("rs") + 1 >= need)
        other = places.select(F.col("g").alias("t"), F.col("n").alias("nt"), F.col("r").alias("rt"), "m", F.col("rest").alias("__t"))
        met = early.join(other, "m").where(order & (F.col("nt") - F.col("rt") + 1 >= need) & (both >= need))
        return met.groupBy("s", "t").agg(F.first("ns").alias("ns"), F.first("nt").alias("nt"), F.max(both).cast("long").alias("shared"))

    near = meeting(0)
    if rounds > 1:
        # one round's places are on disk at a time; what they leave is as small as the overlaps are
        found = reduce(DataFrame.unionByName, [kept(meeting(k)) for k in range(rounds)])
        near = found.groupBy("s", "t").agg(F.first("ns").alias("ns"), F.first("nt").alias("nt"), F.max("shared").alias("shared"))
    if largest <= MEMBERS_INLINE:
        return near
    # larger groups: candidates first, then members in parts
    early = ranked.select(F.col("g").alias("s"), F.col("n").alias("ns"), F.col("r").alias("rs"), "m").where(F.col("ns") - F.col("rs") + 1 >= need)
    other = ranked.where(F.col("n") > MEMBERS_INLINE).select(F.col("g").alias("t"), F.col("n").alias("nt"), F.col("r").alias("rt"), "m")
    met = early.join(other, "m").where((F.col("nt") - F.col("rt") + 1 >= need) & order)
    # of several places that two groups share only the first decides, and what can follow it
    pairs = met.groupBy("s", "t").agg(F.first("ns").alias("ns"), F.first("nt").alias("nt"), F.min("rs").alias("rs"), F.min("rt").alias("rt"))
    pairs = pairs.where(1 + F.least(F.col("ns") - F.col("rs"), F.col("nt") - F.col("rt")) >= need).select("s", "t", "ns", "nt")
    parts = -(-largest // MEMBERS_A_PART)
    part = F.pmod(F.xxhash64("m"), F.lit(parts)) if parts > 1 else F.lit(0)
    listed = m.groupBy("g", part.alias("p")).agg(F.collect_list("m").alias("ms"))
    meet = pairs.join(listed.select(F.col("g").alias("s"), "p", F.col("ms").alias("__s")), "s").join(listed.select(F.col("g").alias("t"), "p", F.col("ms").alias("__t")), ["t", "p"])
    counted = meet.groupBy("s", "t", "ns", "nt").agg(F.sum(F.size(F.array_intersect("__s", "__t"))).alias("shared"))
    return near.unionByName(counted.where(F.col("shared") / F.col("ns") >= min_ratio))


def _members(members: DataFrame, group: str, member: str) -> DataFrame:
    return members.select(F.col(group).alias("g"), F.col(member).alias("m")).where("g IS NOT NULL AND m IS NOT NULL").distinct()


def overlap_pairs(members: DataFrame, group: str, member: str, min_ratio: float = 0.6) -> DataFrame:
    """(a, b, shared, ratio): groups that share at least ``min_ratio`` of the smaller one, each pair once.

    Prefix filtering: with members ordered by rarity, the first one that two such groups share stands early enough in
    both for the rest to make up the share, ceil(ratio x n). Only such places are joined, so a member of very many groups
    pairs them only where rarer ones don't decide. Up to MEMBERS_INLINE members a place brings along what follows it, so a
    pair is decided where it meets and no candidates are stored. Those places go through the cluster in rounds, by members, of about
    ROUND_BYTES each, so the disk holds one round's. Candidates with a larger group meet once more, with their
    members as arrays of at most about MEMBERS_A_PART each. A hot member's rows are a skewed join, which adaptive execution splits.

    Where there are few different members and most groups share some, rarity decides nothing: then groups are compared as bits,
    block by block. That is quadratic in the groups, as are the pairs that come out.
    """
    ratio = F.col("shared") / F.col("ns")
    found = _overlaps(kept(_members(members, group, member)), min_ratio)
    return found.where(ratio >= min_ratio).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "shared", ratio.alias("ratio"))


def overlap_classes(members: DataFrame, group: str, member: str, min_ratio: float = 0.6) -> DataFrame:
    """(g, class_id, n_links): for each group the smallest key of those with the same members, and how many others overlap_pairs
    links it to. Groups of the same members are compared as one, so copies add rows and no pairs.
    """
    m = kept(_members(members, group, member))
    sized = m.groupBy("g").agg(F.count("*").alias("n"))
    small = m.join(sized.where(F.col("n") <= MEMBERS_INLINE).select("g"), "g").groupBy("g").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    same = small.groupBy("ms").agg(F.min("g").alias("class_id"))
    of = kept(small.join(same, "ms").select("g", "class_id").unionByName(sized.where(F.col("n") > MEMBERS_INLINE).select("g", F.col("g").alias("class_id"))))
    weight = of.groupBy("class_id").agg(F.count("*").alias("copies"))
    pairs = kept(_overlaps(m.join(of.where("g = class_id").select("g"), "g", "left_semi"), min_ratio).where(F.col("shared") / F.col("ns") >= min_ratio).select("s", "t", (F.col("ns") + F.col("nt") == 2 * F.col("shared")).alias("equal")))
    ends = pairs.select(F.col("s").alias("g"), F.col("t").alias("class_id")).union(pairs.select("t", "s"))
    links = ends.join(weight, "class_id").groupBy("g").agg(F.sum("copies").alias("links")).withColumnRenamed("g", "class_id")
    equal = pairs.where("equal").groupBy(F.col("t").alias("class_id")).agg(F.min("s").alias("first"))
    out = of.join(weight, "class_id").join(links, "class_id", "left").join(equal, "class_id", "left")
    return out.select("g", F.coalesce("first", "class_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def name_containment(names: DataFrame, name: str, width: int = 4) -> DataFrame:
    """(a, b): names one of which contains the other, through shared character n-grams instead of all pairs.

    The shorter name's first n-gram must occur in the longer one; then containment is checked.
    """
    n = names.select(F.lower(F.trim(F.col(name))).alias("n")).where(F.length("n") > 0).distinct()
    grams = F.when(F.length("n") <= width, F.array(F.col("n"))).otherwise(F.transform(F.sequence(F.lit(1), F.length("n") - width + 1), lambda i: F.call_function("substring", F.col("n"), i, F.lit(width))))
    short = F.transform(F.sequence(F.lit(1), F.lit(width - 1)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("n") - k + 1, F.lit(1))), lambda i: F.call_function("substring", F.col("n"), i, k)))
    posts = n.select(F.col("n").alias("b"), F.explode(F.array_distinct(F.concat(grams, F.flatten(short)))).alias("g"))
    probes = n.select(F.col("n").alias("a"), F.substring("n", 1, width).alias("g"))
    return probes.join(posts, "g").where(F.col("b").contains(F.col("a")) & (F.col("a") != F.col("b"))).select("a", "b").distinct()


#: Probes of at most so many bytes are broadcast; a probe's row takes about PROBE_ROW besides its text.
PROBE_BYTES, PROBE_ROW = 64 << 20, 64


def probe_match(texts: DataFrame, titles: DataFrame, text_key: str, text: str, title_key: str, title: str, words: int = 4, limit: int = 5, domain: DataFrame | None = None) -> DataFrame:
    """(text_key, title_key): texts that quote ``words`` consecutive words of a title, or a window of its
    CJK runs, at most ``limit`` titles each, those with most hits first.

    Probes that are measured to be small are broadcast: of the texts' windows only those that a title has are shuffled.

    CJK windows have 16 or 12 characters, and 8 too where the title of over 8 characters holds a gram of
    ``domain`` (gram; by default the titles' own domain_grams). They slide by one character.
    """
    from marginalia.operators.views import domain_grams

    grams = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - words + 1), lambda i: F.array_join(F.slice(c, i, words), " "))
    tokens = lambda df, key, c: df.select(key, F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)).alias("w")).where(F.size("w") >= words)
    runs = lambda c: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit("[\u4e00-\u9fff]+"), F.lit(0))
    cut = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - n + 1, F.lit(1))), lambda i: F.call_function("substring", r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    windows = lambda c, sizes: F.array_distinct(F.flatten(F.transform(runs(c), lambda r: F.concat(*[cut(r, n) for n in sizes]))))
    long = titles.where(F.length(title) > 8)
    own = (domain_grams(titles, title) if domain is None else domain).select("gram").distinct()
    inside = long.select(title_key, F.explode(windows(title, (2,))).alias("gram")).join(own, "gram").select(title_key).distinct()
    narrow = long.join(inside, title_key, "left_semi").select(title_key, F.explode(windows(title, (8,))).alias("g"))
    probes = (
        tokens(titles, title_key, title).select(title_key, F.explode(F.array_distinct(grams(F.col("w")))).alias("g"))
        .union(long.select(title_key, F.explode(windows(title, (16, 12))).alias("g"))).union(narrow).distinct()
    )
    places = (
        tokens(texts, text_key, text).select(text_key, F.explode(F.array_distinct(grams(F.col("w")))).alias("g"))
        .union(texts.select(text_key, F.explode(windows(text, (16, 12, 8))).alias("g")))
    )
    probes = kept(probes)
    size = probes.agg(F.coalesce(F.sum(F.octet_length("g") + F.octet_length(F.col(title_key).cast("string")) + PROBE_ROW), F.lit(0))).first()[0]
    if size <= PROBE_BYTES:
        places = places.join(F.broadcast(probes.select("g").distinct()), "g", "left_semi")
    hits = places.distinct().join(F.broadcast(probes) if size <= PROBE_BYTES else probes, "g").groupBy(text_key, title_key).agg(F.count("*").alias("hits"))
    w = Window.partitionBy(text_key).orderBy(F.desc("hits"), title_key)
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)


def edit_overlay(machine: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Pages with hand edits over them: text, edited, and stale where the machine text changed since the edit."""
    e = edits.select(*keys, F.col("text").alias("__text"), F.col("base_hash").alias("__base"))
    now = F.substring(F.sha1(F.coalesce("text", F.lit(""))), 1, 16)
    return machine.join(e, keys, "left").select(
        *[c for c in machine.columns if c != "text"], F.coalesce("__text", "text").alias("text"), F.col("__text").isNotNull().alias("edited"), (F.col("__base").isNotNull() & (F.col("__base") != now)).alias("stale"))


def parent_for_offset(children: DataFrame, parts: DataFrame, key: str, ranges: int = 200) -> DataFrame:
    """As-of join: for each child the last part of its section that starts at or before its offset (column
    ``parent_part``; null without one). Of parts with one start the largest part_id counts.

    One shuffle by (key, range of offsets): the ranges are quantiles of all offsets, so one key with a third of all
    rows is dealt to many tasks. Each range begins with the last part of the ranges before it.
    """
    kids = children.select(F.col(key).alias("k"), F.col("offset").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(parts.schema["part_id"].dataType).alias("part"), F.struct(*[F.col(f"`{c}`") for c in children.columns]).alias("row"))
    heads = parts.where(F.col(key).isNotNull() & F.col("start").isNotNull()).select(F.col(key).alias("k"), F.col("start").cast(children.schema["offset"].dataType).alias("at"), F.lit(0).alias("side"), F.col("part_id").alias("part"))
    places = kids.select("at").union(heads.select("at"))
    bounds = places.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    slot = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(bounds))]), lambda x: x <= F.col("at"))) if bounds else F.lit(0)
    kids, heads = kids.withColumn("slot", slot), heads.withColumn("slot", slot)
    # at most one row for each key and range
    last = heads.groupBy("k", "slot").agg(F.max(F.struct("at", "part")).alias("head"))
    used = last.unionByName(kids.select("k", "slot").distinct(), allowMissingColumns=True).groupBy("k", "slot").agg(F.first("head", ignorenulls=True).alias("head"))
    before = Window.partitionBy("k").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = used.withColumn("head", F.last("head", ignorenulls=True).over(before)).where("head IS NOT NULL").select("k", "slot", "head.at", F.lit(0).alias("side"), "head.part")
    rows = kids.unionByName(heads, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    upto = Window.partitionBy("k", "slot").orderBy(F.col("at").asc_nulls_first(), "side", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("parent_part", F.last("part", ignorenulls=True).over(upto)).where("side = 1").select("row.*", "parent_part")


def interval_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes [x0, y0, x1, y1]."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = w * h
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def nearest_block(points: DataFrame, blocks: DataFrame, max_distance: float = 0.06) -> DataFrame:
    """For each (page, x, y) the block of its page that holds it, the smallest first, else the nearest centre within reach."""
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    far = F.sqrt(F.pow(F.col("x") - (F.col("x0") + F.col("x1")) / 2, 2) + F.pow(F.col("y") - (F.col("y0") + F.col("y1")) / 2, 2))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    order = F.struct(F.when(inside, 0).otherwise(1), F.when(inside, area).otherwise(far), F.col("block_id"))
    return points.join(blocks, "page").where(inside | (far <= max_distance)).groupBy("point_id").agg(F.min_by("block_id", order).alias("block_id"))


def merge_candidates(a: DataFrame, b: DataFrame, prefer: dict[str, str] | None = None) -> DataFrame:
    """Two sources' (item, field, value) side by side: both, single or conflict, and the value preferred for the field."""
    norm = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Punct}]+", ""))
    j = a.alias("a").join(b.alias("b"), (F.col("a.item") == F.col("b.item")) & (F.col("a.field") == F.col("b.field")), "full_outer")
    va, vb = F.col("a.value"), F.col("b.value")
    field = F.coalesce(F.col("a.field"), F.col("b.field"))
    use_b = F.lit(False)
    for name, side in (prefer or {}).items():
        use_b = use_b | ((field == name) & F.lit(side == "b"))
    return j.select(F.coalesce(F.col("a.item"), F.col("b.item")).alias("item"), field.alias("field"),
                    F.when(va.isNull() | vb.isNull(), "single").when(norm(va) == norm(vb), "both").otherwise("conflict").alias("state"),
                    F.when(use_b, F.coalesce(vb, va)).otherwise(F.coalesce(va, vb)).alias("value"))


def running_headers(pages: DataFrame, key: str, page: str, text: str = "text", head: int = 2, tail: int = 2, min_share: float = 0.35, max_len: int = 300, min_pages: int = 3) -> DataFrame:
    """(key, pattern, n): edge lines, digits aside, that recur on at least max(2, round(share x pages)) pages.

    Only pages of four or more lines vote; documents of fewer than ``min_pages`` pages have none.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    listed = pages.select(key, page, lines.alias("l"))
    counts = pages.groupBy(key).agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    edges = F.concat(F.slice("l", 1, head), F.slice("l", F.size("l") - tail + 1, tail))
    votes = listed.where(F.size("l") >= 4).select(key, page, F.explode(edges).alias("line")).select(key, edge_form(F.col("line")).alias("pattern")).where((F.col("pattern") != "") & (F.length("pattern") <= max_len))
    return votes.groupBy(key, "pattern").agg(F.count("*").alias("n")).join(counts, key).where(F.col("n") >= F.greatest(F.lit(2), F.bround(F.col("pages") * min_share))).select(key, "pattern", "n")


def drop_running_headers(pages: DataFrame, key: str, page: str, text: str = "text") -> DataFrame:
    """Pages without the lines that match a running header of their document, wherever they stand."""
    found = running_headers(pages, key, page, text).groupBy(key).agg(F.collect_list("pattern").alias("__bad"))
    kept = F.filter(F.split(F.col(text), "\n"), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__bad"), edge_form(x)))
    return pages.join(found, key, "left").withColumn(text, F.when(F.col("__bad").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__bad")


def sync_extras(stored: DataFrame, parsed: DataFrame, key: str = "item_key", raw: str = "extra_raw") -> DataFrame:
    """Stored extras after a sync: parsed rows replace those of their items, and an item whose extra is now blank has none."""
    filled = parsed.where(F.trim(F.coalesce(raw, F.lit(""))) != "")
    return upsert(stored.join(parsed.select(key).distinct(), key, "left_anti"), filled, [key])


def sync_counts(stored: DataFrame, parsed: DataFrame, key: str = "item_key", raw: str = "extra_raw") -> DataFrame:
    """One row (items, rows, cleared): items seen, rows written, and stored rows that went because the extra is blank."""
    blank = F.trim(F.coalesce(F.col(raw), F.lit(""))) == ""
    have = stored.select(key, F.lit(1).alias("__had")).distinct()
    return parsed.join(have, key, "left").agg(F.count("*").alias("items"), F.count(F.when(~blank, 1)).alias("rows"), F.count(F.when(blank, F.col("__had"))).alias("cleared"))


def current_vectors(vectors: DataFrame, model: str, last_model: str | None) -> DataFrame:
    """Vectors that still count: all, unless the last build names another model; then only those of ``model``."""
    return vectors.where(F.col("model") == model) if last_model and last_model != model else vectors
