"""The feedback ledger: outcomes to weights, and their views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import scalars as sc
from marginalia.operators.relational import kept

OUTCOMES = ("effective", "ineffective", "partial")


def ledger_weights(ledger: DataFrame, item: str = "item_key") -> DataFrame:
    """(item, attempts, effective, ineffective, partial): every entry counts an attempt, unknown outcomes nothing else."""
    return ledger.groupBy(item).agg(F.count("*").alias("attempts"), *[F.sum(F.when(F.col("outcome") == o, 1).otherwise(0)).cast("long").alias(o) for o in OUTCOMES])


def explode_items(ledger: DataFrame, keys: str = "item_keys", item: str = "item_key") -> DataFrame:
    return ledger.withColumn(item, F.explode(F.array_distinct(F.col(keys))))


def folded_count(steps: DataFrame, key: list[str], order: list[str], delta: str = "delta") -> DataFrame:
    """(key, value): a running sum that never falls below zero, step by step in order.

    With floors the order matters. The final value is the sum of all steps less the lowest
    running sum, where that is negative: no sequential pass is needed.
    """
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = steps.withColumn("__run", F.sum(delta).over(w))
    return run.groupBy(*key).agg((F.sum(delta) - F.least(F.lit(0), F.min("__run"))).cast("long").alias("value"))


def multipliers(items: DataFrame, weights: DataFrame, health: DataFrame, now_year: int, key: str = "item_key", year: str = "year") -> DataFrame:
    """(item, base, multiplier): items lead the join, so an item without a ledger has its recency only."""
    j = items.select(key, F.col(year).alias("__year")).join(weights, key, "left").join(health.select(key, "verdict"), key, "left")
    base = sc.recency_base(F.col("__year"), now_year)
    raw = sc.raw_weight(base, F.col("pinned"), F.col("manual"), F.col("effective"), F.col("ineffective"), F.col("partial"))
    return j.select(key, base.alias("base"), sc.weight_multiplier(raw, F.col("verdict") == "bad").alias("multiplier"))


def weight_board(weights: DataFrame, items: DataFrame, key: str = "item_key", limit: int = 50) -> DataFrame:
    score = sc.board_score(F.col("pinned"), F.col("manual"), F.col("effective"), F.col("ineffective"))
    return weights.join(items, key, "left").withColumn("board", score).orderBy(F.desc("board"), key).limit(limit)


def renumber(ledger: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """Ids 1..N in order. A range sort and counts of its partitions, so no task holds the whole ledger."""
    # stored once: both branches below must see the same partitions
    parts = kept(ledger.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    placed = parts.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    return placed.join(before, "__p").withColumn(id_col, (F.col("__before") + F.col("__r")).cast("long")).drop("__p", "__r", "__before")


def related(ledger: DataFrame, words: list[str], keys: list[str], limit: int = 20) -> DataFrame:
    """Entries that mention one of the first 8 words (two or more characters) or hold one of the first 10 keys, newest first."""
    hit = F.lit(False)
    for w in [w for w in words if len(w) >= 2][:8]:
        for c in ("asked", "method", "context", "reason"):
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(w.lower()), F.lit(False))
    for k in keys[:10]:
        hit = hit | F.array_contains("item_keys", k)
    return ledger.where(hit).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def without_tests(ledger: DataFrame, markers: list[str]) -> DataFrame:
    bad = F.lit(False)
    for m in markers:
        bad = bad | F.coalesce(F.col("asked").contains(m) | F.col("method").contains(m), F.lit(False))
    return ledger.where(~bad)


def clean_ledger(ledger: DataFrame, weights: DataFrame, markers: list[str], order: list[str], item: str = "item_key") -> tuple[DataFrame, DataFrame]:
    """(ledger, weights) without test rows, those whose question or tags hold a marker.

    Stored counts are rolled back by what the test rows had added to their items, never below zero, and weights that say nothing any more go. The
    rest is numbered anew in ``order``.
    """
    bad = F.lit(False)
    for m in markers:
        bad = bad | F.coalesce(F.col("asked").contains(m), F.lit(False)) | F.coalesce(F.col("tags").contains(m), F.lit(False))
    undo = ledger_weights(explode_items(ledger.where(bad), item=item), item)
    counts = ("attempts", *OUTCOMES)
    less = weights.join(undo.select(item, *[F.col(c).alias(f"__{c}") for c in counts]), item, "left")
    back = less.select(*[F.greatest(F.col(c) - F.coalesce(f"__{c}", F.lit(0)), F.lit(0)).alias(c) if c in counts else F.col(c) for c in weights.columns])
    return renumber(ledger.where(~bad), order), without_idle(back)


def new_entries(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """Import without repeats of (asked, method, outcome); nulls compare equal."""
    i, o = incoming.alias("i"), ledger.select("asked", "method", "outcome").distinct().alias("o")
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("asked", "method", "outcome")]
    return i.join(o, same, "left_anti").dropDuplicates(["asked", "method", "outcome"])


def orphan_weights(weights: DataFrame, ledger: DataFrame, key: str = "item_key") -> DataFrame:
    """Weights without any ledger entry, pin or manual part: an equi anti-join on exploded keys, not a substring search."""
    used = explode_items(ledger, item=key).select(key)
    idle = (F.coalesce("pinned", F.lit(0)) == 0) & (F.coalesce("manual", F.lit(0.0)) == 0)
    return weights.where(idle).join(used, key, "left_anti")


def update_entries(ledger: DataFrame, edits: DataFrame, when: str, fields: tuple[str, ...] = ("asked", "method", "outcome", "reason", "context")) -> DataFrame:
    """Edited entries with their old values added to ``history`` (array of JSON), others as they are.

    Weights are derived from the ledger, so an edit needs no rollback: they follow from what stands.
    """
    e = edits.select("id", *[F.col(f).alias(f"__{f}") for f in fields if f in edits.columns], F.lit(True).alias("__hit"))
    changed = [f for f in fields if f"__{f}" in e.columns]
    j = ledger.join(e, "id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    entry = F.to_json(F.struct(F.lit(when).alias("at"), *[F.col(f) for f in changed]))
    history = F.coalesce("history", F.array().cast("array<string>"))
    return j.select(*[F.when(hit, F.coalesce(f"__{c}", c)).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in ledger.columns if c != "history"],
                    F.when(hit, F.concat(history, F.array(entry))).otherwise(history).alias("history"))


def delete_entries(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """The ledger without the given ids, numbered 1..N again."""
    return renumber(ledger.join(ids.select("id"), "id", "left_anti"), ["id"])


def entry_views(ledger: DataFrame) -> DataFrame:
    """Entries for display: how many items and edits, and the items as one text."""
    keys = F.coalesce("item_keys", F.array().cast("array<string>"))
    return ledger.select("id", "created_at", "asked", "outcome", F.array_join(keys, ", ").alias("items"), F.size(keys).alias("n_items"), F.size(F.coalesce("history", F.array().cast("array<string>"))).alias("n_edits"))


def checkup_reason(outcome, evidence, keys):
    """Why an entry deserves a second look; empty if it doesn't."""
    return F.when(F.size(F.coalesce(keys, F.array().cast("array<string>"))) == 0, "no item").when(~F.coalesce(outcome, F.lit("")).isin("effective", "ineffective", "partial", "unknown"), "unknown outcome").when((outcome == "effective") & (F.trim(F.coalesce(evidence, F.lit(""))) == ""), "no evidence").otherwise("")


def without_idle(weights: DataFrame) -> DataFrame:
    """Weights without the rows that say nothing: no attempt, pin, outcome or manual part."""
    zero = F.lit(True)
    for c in ("attempts", *OUTCOMES):
        zero = zero & (F.coalesce(c, F.lit(0)) <= 0)
    for c in ("pinned", "manual"):
        zero = zero & (F.coalesce(c, F.lit(0)) == 0)
    return weights.where(~zero)


def export_entries(ledger: DataFrame, path: str) -> None:
    """The ledger as JSON lines, one file a partition; new_entries takes them back without repeats."""
    ledger.write.mode("overwrite").json(path)
