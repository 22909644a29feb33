"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Leaves are (domain, lang, source). A token budget goes down the tree: at each node the budget is
split among the children by weight. A child can take ``max_epochs`` times the tokens below it;
what it can't take goes to its siblings by their weights, until they are full too. Since a node
never gets more than its subtree can take, a shortage reaches an ancestor's siblings only when
all nearer ones are full. Shares are whole tokens, rounded down.

A leaf takes whole epochs and then a prefix of one more, in the order of an md5 of the seed, the
epoch and the document. The cut of that prefix is found by radix selection: three histograms of
256 bins over the leading hex digits leave one short run of documents to sum in order. So no task ever sorts a
leaf, and a leaf may hold any share of all rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.shared import stored

TOKEN = r"[^\x20\x09-\x0D]+"
LEAF = ["domain", "lang", "source"]
#: Tables of more leaves than this are joined by shuffles instead of being broadcast.
MAX_BROADCAST_LEAVES = 20_000


@dataclass(frozen=True)
class Mix:
    """budget: hundredths of the corpus' tokens. Weights are whole numbers; names not listed weigh 1."""

    budget_percent: int = 60
    max_epochs: int = 2
    seed: str = "mix"
    domains: Mapping[str, int] = field(default_factory=lambda: {"d0": 5, "d1": 3, "d2": 2, "d3": 1})
    langs: Mapping[str, int] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2})
    sources: Mapping[str, int] = field(default_factory=dict)


def domain_of(source: Column) -> Column:
    """The tables have no domain column: sources are dealt to d0..d3 by a digit of their md5."""
    return F.concat(F.lit("d"), F.conv(F.substring(F.md5(source), 1, 1), 16, 10).cast("int") % 4)


def _weight(weights: Mapping[str, int], name: Column) -> Column:
    found = F.lit(1)
    for key in sorted(weights):
        found = F.when(name == key, F.lit(int(weights[key]))).otherwise(found)
    return found.cast("long")


def fill(nodes: DataFrame, parent: list[str], weight: Column) -> DataFrame:
    """Split each parent's ``budget`` among its children by water filling.

    ``nodes`` has the parent's columns, ``room`` (what a child can take, over 0) and ``budget``
    (the parent's, at most the sum of its children's room). Adds ``share``. Children that are
    full earliest have the least room for their weight; the level at which the budget runs out
    is found from running sums in that order.
    """
    by = Window.partitionBy(*parent).orderBy("__full", "__name")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy(*parent)
    big = "decimal(38,0)"
    ranked = (
        nodes.withColumn("__w", weight).withColumn("__full", F.col("room") / F.col("__w"))
        .withColumn("__taken", F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("__open", F.sum("__w").over(onwards))
        # full if all that is left, dealt by weight among those not yet full, covers its room
        .withColumn("__is_full", ((F.col("budget") - F.col("__taken")).cast(big) * F.col("__w") >= F.col("room").cast(big) * F.col("__open")))
    )
    open_now = ranked.withColumn("__open_w", F.sum(F.when(~F.col("__is_full"), F.col("__w"))).over(everyone)).withColumn(
        "__spent", F.coalesce(F.sum(F.when(F.col("__is_full"), F.col("room"))).over(everyone), F.lit(0))
    )
    share = F.when(F.col("__is_full"), F.col("room")).otherwise(F.expr("cast((cast(budget - __spent as decimal(38,0)) * __w) div __open_w as bigint)"))
    return open_now.withColumn("share", share.cast("long")).drop("__w", "__full", "__taken", "__open", "__is_full", "__open_w", "__spent")


def budgets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens) to the same with ``share``, the leaf's tokens to take."""
    leaves = sizes.withColumn("room", F.col("tokens") * mix.max_epochs)
    both = [F.sum(c).alias(c) for c in ("tokens", "room")]
    langs = leaves.groupBy("domain", "lang").agg(*both)
    domains = langs.groupBy("domain").agg(*both).withColumn("root", F.lit(0)).withColumn("__name", F.col("domain"))
    everything = Window.partitionBy("root")
    domains = domains.withColumn("__all", F.sum("tokens").over(everything)).withColumn("budget", F.least(F.expr(f"(__all * {mix.budget_percent}) div 100"), F.sum("room").over(everything)))
    top = fill(domains, ["root"], _weight(mix.domains, F.col("domain"))).select("domain", F.col("share").alias("budget"))
    mid = langs.join(top, "domain").withColumn("__name", F.col("lang"))
    mid = fill(mid, ["domain"], _weight(mix.langs, F.col("lang"))).select("domain", "lang", F.col("share").alias("budget"))
    low = leaves.join(mid, ["domain", "lang"]).withColumn("__name", F.col("source"))
    return fill(low, ["domain", "lang"], _weight(mix.sources, F.col("source"))).select(*LEAF, "tokens", "share")


def order_key(seed: str, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), doc_id.cast("string")))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents chosen: doc_id, domain, lang, source, n_tokens, epochs (how often to repeat it).

    Tokens are runs of characters other than ASCII white space. Rows without a token, a doc_id,
    a lang or a source: a null lang or source is the leaf ``""``; a null id sorts as ``""``;
    rows without a token are never chosen. Rows that share an id have one place in the order and
    are taken together or not at all. Texts of any length are counted whole. Other columns are
    not used. An empty table gives no rows.
    """
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source"))
    rows = stored(
        docs.select("doc_id", lang.alias("lang"), source.alias("source"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0))).cast("long").alias("n_tokens"))
        .where("n_tokens > 0").withColumn("domain", domain_of(F.col("source"))),
        "mix-rows",
    )
    leaves = stored(
        budgets(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), mix)
        .withColumn("epoch", F.expr("share div tokens")).withColumn("rest", F.expr("share % tokens")),
        "mix-leaves",
    )
    small = F.broadcast if leaves.count() <= MAX_BROADCAST_LEAVES else (lambda df: df)
    keyed = rows.join(small(leaves.select(*LEAF, "epoch", "rest")), LEAF).withColumn("key", order_key(mix.seed, F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))

    # radix selection of the cut: the bin in which the running sum passes the rest, of 256 at a time
    cut = leaves.select(*LEAF, F.col("rest").alias("left"), F.lit("").alias("prefix"))
    for digits in (2, 4, 6):
        bins = (
            keyed.select(*LEAF, "n_tokens", F.substring("key", 1, digits - 2).alias("prefix"), F.substring("key", 1, digits).alias("bin"))
            .join(small(cut), [*LEAF, "prefix"]).groupBy(*LEAF, "left", "bin").agg(F.sum("n_tokens").alias("t"))
        )
        run = F.sum("t").over(Window.partitionBy(*LEAF).orderBy("bin"))
        cut = stored(
            bins.withColumn("run", run).where((F.col("run") > F.col("left")) & (F.col("run") - F.col("t") <= F.col("left")))
            .select(*LEAF, (F.col("left") - (F.col("run") - F.col("t"))).alias("left"), F.col("bin").alias("prefix")),
            f"mix-cut-{digits}",
        )
    last = keyed.select(*LEAF, "n_tokens", "key", F.substring("key", 1, 6).alias("prefix")).join(small(cut), [*LEAF, "prefix"])
    peers = Window.partitionBy(*LEAF).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        last.withColumn("run", F.sum("n_tokens").over(peers))
        .groupBy(*LEAF, "prefix").agg(F.max(F.when(F.col("run") <= F.col("left"), F.col("key"))).alias("key"))
        .select(*LEAF, F.coalesce("key", "prefix").alias("end"))
    )
    ends = leaves.select(*LEAF).join(ends, LEAF, "left").select(*LEAF, F.coalesce("end", F.lit("")).alias("end"))
    ends = stored(ends, "mix-ends")
    # the rest is less than the leaf's tokens, so every leaf has a bin in which the running sum passes it
    taken = F.col("epoch") + F.when(F.col("key") <= F.col("end"), 1).otherwise(0)
    return keyed.join(small(ends), LEAF).withColumn("epochs", taken.cast("long")).where("epochs > 0").select("doc_id", *LEAF, "n_tokens", "epochs")
