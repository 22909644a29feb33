"""Findings that wait for a decision: marks arrive as a stream, and each batch of them is merged once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.sources.stored import StoredTables

PENDING, REFUSED = "pending", "refused"
DECISIONS = ("approved", "rejected")


def judged(pending: DataFrame, marks: DataFrame, batch: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(changed rows, refused marks) of one batch. pending: key, id, status, batch, and more; marks: key, id, status, at.

    Of several marks for one row in a batch the first by time counts. A mark is refused if the row is unknown or decided
    already, or if the status is no decision. A row decided by this batch or a later one is left as it is, so a replayed batch
    changes nothing.
    """
    first = Window.partitionBy(key, "id").orderBy(F.col("at").asc_nulls_last(), "status")
    ranked = marks.select(key, "id", F.col("status").alias("__status"), F.row_number().over(first).alias("__r"))
    j = ranked.join(pending, [key, "id"], "left")
    replayed = F.coalesce(F.col("batch") >= batch, F.lit(False))
    why = (
        F.when(F.col("status").isNull(), "unknown").when(~F.col("__status").isin(*DECISIONS), "no decision").when(F.col("__r") > 1, "marked twice")
        .when((F.col("status") != "pending") & ~replayed, F.concat(F.lit("already "), F.col("status")))
    )
    j = j.withColumn("__why", why)
    good = j.where("__why IS NULL").where(~replayed)
    changed = good.select(*[F.col("__status").alias(c) if c == "status" else F.lit(batch).cast(pending.schema["batch"].dataType).alias(c) if c == "batch" else F.col(c) for c in pending.columns])
    refused = j.where("__why IS NOT NULL").select(key, "id", F.col("__status").alias("status"), F.lit(batch).cast("long").alias("batch"), F.col("__why").alias("why"))
    return changed, refused


def merge_marks(tables: StoredTables, marks: DataFrame, batch: int) -> None:
    """Carry one batch of marks into the stored tables ``pending`` and ``refused``, both in one change."""
    key = tables.key
    touched = marks.select(key).distinct()
    pending = tables.of_items(PENDING, touched)
    changed, refused = judged(pending, marks, batch, key)
    rows = pending.join(changed.select(key, "id"), [key, "id"], "left_anti").unionByName(changed)
    known = tables.of_items(REFUSED, touched)
    tables.change({PENDING: rows, REFUSED: known.where(F.col("batch") != batch).unionByName(refused).distinct()})


def follow_marks(tables: StoredTables, marks: DataFrame, checkpoint: str):
    """Merge a stream of marks, batch by batch; what a lost driver left committed is carried out first."""

    def each(batch: DataFrame, number: int) -> None:
        tables.recover()
        merge_marks(tables, batch.persist(), number)
        batch.unpersist()

    return marks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
