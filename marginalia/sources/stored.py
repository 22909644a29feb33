"""Tables kept under one folder, changed together, and archives of items.

A table is Parquet, dealt to buckets by a hash of the item key, so that a change rewrites only the buckets that it touches. A change
of any number of tables is staged first, by ordinary Spark jobs; renaming its folder is the moment from which it counts. Then the touched
buckets are overwritten. What a lost driver leaves behind is either staged only, and dropped by ``recover``, or committed, and
carried out by it: doing so twice gives the same tables. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket"
STAGED, COMMITTED, ARCHIVES, STALE = "_staged", "_committed", "_archives", ".stale"
#: Conflicting ids that a refused restore names.
SHOWN_CONFLICTS = 20


class Folder:
    """The few file operations that are needed, in whatever store Hadoop opens."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._streams = spark._jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def rename(self, old: str, new: str) -> None:
        self._fs.mkdirs(self._path(new).getParent())
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def write(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        source = self._fs.open(self._path(path))
        try:
            return self._streams.toString(source, "UTF-8")
        finally:
            source.close()


class RestoreRefused(RuntimeError):
    """Ids of an archive now belong to other items; nothing was written."""

    def __init__(self, conflicts: list[str]):
        super().__init__(f"ids are taken: {', '.join(conflicts)}")
        self.conflicts = conflicts


@dataclass(frozen=True)
class StoredTables:
    """spark, the folder, the column all tables share, the number of buckets (fixed for the folder's life), and how many tasks
    write one bucket, which a bucket of a hot item needs."""

    spark: SparkSession
    root: str
    key: str = "item_key"
    buckets: int = 64
    spread: int = 1

    def _folder(self) -> Folder:
        return Folder(self.spark, self.root)

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def names(self) -> list[str]:
        return [n for n in self._folder().names(self.root) if not n.startswith("_")]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}").drop(BUCKET)

    def of_items(self, name: str, keys: DataFrame) -> DataFrame:
        """A table's rows of some items; only their buckets are read."""
        wanted = keys.select(self.key).distinct()
        slots = self._slots(wanted)
        rows = self.spark.read.parquet(f"{self.root}/{name}").where(F.col(BUCKET).isin(slots) if slots else F.lit(False))
        return rows.join(wanted, self.key, "left_semi").drop(BUCKET)

    def _dealt(self, df: DataFrame) -> DataFrame:
        """Rows with their bucket, each bucket in ``spread`` tasks."""
        slots = df.withColumn(BUCKET, self._slot())
        return slots.repartition(F.col(BUCKET), F.pmod(F.xxhash64(*df.columns), F.lit(self.spread))) if self.spread > 1 else slots.repartition(BUCKET)

    def create(self, name: str, df: DataFrame) -> None:
        self._dealt(df).write.partitionBy(BUCKET).parquet(f"{self.root}/{name}")

    def _slots(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self._slot().alias(BUCKET)).distinct().collect())

    def change(self, rows: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None, **note: str) -> None:
        """Rewrite whole items: those of ``gone`` (table to keys) leave, and ``rows`` (table to rows) take the place of all
        rows of their items. Tables, or buckets, that neither touches keep their files."""
        rows, gone = rows or {}, gone or {}
        folder, name = self._folder(), f"{len(self._folder().names(f'{self.root}/{COMMITTED}')):06d}-{uuid.uuid4().hex[:12]}"
        stage, touched = f"{self.root}/{STAGED}/{name}", {}
        for table in sorted({*rows, *gone}):
            new = rows.get(table)
            keys = [df.select(self.key) for df in (new, gone.get(table)) if df is not None]
            leave = keys[0].union(keys[1]).distinct() if len(keys) > 1 else keys[0].distinct()
            touched[table] = self._slots(leave)
            if not touched[table]:
                continue
            old = self.spark.read.parquet(f"{self.root}/{table}").where(F.col(BUCKET).isin(touched[table]))
            kept = old.join(leave, self.key, "left_anti")
            merged = kept.drop(BUCKET) if new is None else kept.drop(BUCKET).unionByName(new, allowMissingColumns=True)
            self._dealt(merged).write.partitionBy(BUCKET).parquet(f"{stage}/{table}")
        folder.write(f"{stage}/_change.json", json.dumps({"touched": touched, **note}))
        self._commit(name)
        self._carry_out(name)

    def _commit(self, name: str) -> None:
        self._folder().rename(f"{self.root}/{STAGED}/{name}", f"{self.root}/{COMMITTED}/{name}")

    def _carry_out(self, name: str) -> None:
        folder, at = self._folder(), f"{self.root}/{COMMITTED}/{name}"
        what = json.loads(folder.read(f"{at}/_change.json"))
        for table, slots in what["touched"].items():
            if not slots:
                continue
            filled = set()
            if folder.exists(f"{at}/{table}"):
                filled = {int(n.partition("=")[2]) for n in folder.names(f"{at}/{table}") if n.startswith(f"{BUCKET}=")}
            if filled:
                staged = self.spark.read.parquet(f"{at}/{table}").drop(BUCKET)
                self._dealt(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.root}/{table}")
            for slot in set(slots) - filled:  # all rows of the bucket left
                folder.delete(f"{self.root}/{table}/{BUCKET}={slot}")
        if "archived" in what and folder.exists(f"{self.root}/{STAGED}-{what['archived']}"):
            folder.rename(f"{self.root}/{STAGED}-{what['archived']}", f"{self.root}/{ARCHIVES}/{what['archived']}")
        if "restored" in what:
            folder.delete(f"{self.root}/{ARCHIVES}/{what['restored']}")
        folder.delete(at)

    def recover(self) -> list[str]:
        """Carry out what was committed and drop what wasn't, after a lost driver; the names of the changes carried out."""
        folder = self._folder()
        done = folder.names(f"{self.root}/{COMMITTED}")
        for name in done:
            self._carry_out(name)
        for name in folder.names(self.root):
            if name.startswith(STAGED):
                folder.delete(f"{self.root}/{name}")
        return done

    # --- archives ------------------------------------------------------------------------------------------------------

    def archive(self, keys: DataFrame, batch: str) -> dict[str, int]:
        """Move the rows of some items out of all tables into an archive with a manifest; the number of rows of each table."""
        folder, stage = self._folder(), f"{self.root}/{STAGED}-{batch}"
        if folder.exists(f"{self.root}/{ARCHIVES}/{batch}"):
            raise ValueError(f"there is an archive {batch}")
        folder.delete(stage)
        counts = {}
        for table in self.names():
            self.of_items(table, keys).write.parquet(f"{stage}/{table}")
            counts[table] = self.spark.read.parquet(f"{stage}/{table}").count()
        folder.write(f"{stage}/_manifest.json", json.dumps({"key": self.key, "rows": counts}))
        self.change(gone=dict.fromkeys(self.names(), keys), archived=batch)
        return counts

    def archives(self) -> dict[str, dict[str, int]]:
        """Archive to the rows of each of its tables; stale ones are left out."""
        folder = self._folder()
        return {n: json.loads(folder.read(f"{self.root}/{ARCHIVES}/{n}/_manifest.json"))["rows"] for n in folder.names(f"{self.root}/{ARCHIVES}") if not n.endswith(STALE)}

    def archived(self, batch: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{ARCHIVES}/{batch}/{table}")

    def conflicts(self, batch: str, ids: dict[str, str]) -> DataFrame:
        """(table, id, archived_owner, live_owner): ids (table to id column) of an archive that other items have taken since."""
        found = None
        for table, column in ids.items():
            live = self.read(table).select(F.col(column).cast("string").alias("id"), F.col(self.key).cast("string").alias("live_owner"))
            old = self.archived(batch, table).select(F.col(column).cast("string").alias("id"), F.col(self.key).cast("string").alias("archived_owner"))
            rows = old.join(live, "id").where("archived_owner <> live_owner").select(F.lit(table).alias("table"), "id", "archived_owner", "live_owner")
            found = rows if found is None else found.unionByName(rows)
        return found

    def restore(self, batch: str, ids: dict[str, str], renew: dict[str, dict[str, Column]] | None = None) -> dict[str, int]:
        """Put an archive's rows back into all tables, in one change; rows that its items have by now leave.

        ids: table to id column. If one id now belongs to another item the restore is refused whole: nothing is written,
        the archive is renamed so that it isn't tried again, and RestoreRefused names the ids. renew: table to columns that
        are set anew, as an item's version.
        """
        folder, counts = self._folder(), self.archives()[batch]
        taken = [f"{r['table']} {r['id']} ({r['live_owner']})" for r in self.conflicts(batch, ids).limit(SHOWN_CONFLICTS).collect()]
        if taken:
            folder.rename(f"{self.root}/{ARCHIVES}/{batch}", f"{self.root}/{ARCHIVES}/{batch}{STALE}")
            raise RestoreRefused(taken)
        rows = {t: self.archived(batch, t) for t in counts}
        for table, columns in (renew or {}).items():
            rows[table] = rows[table].withColumns(columns)
        self.change(rows, restored=batch)
        return counts

    def purge(self, batch: str) -> None:
        """Forget an archive."""
        self._folder().delete(f"{self.root}/{ARCHIVES}/{batch}")
