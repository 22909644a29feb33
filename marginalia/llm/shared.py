"""Helpers that every training-data operator uses: shared storage, input tables, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SETTING = "spark.checkpoint.dir"
_SPARE = "__payload_of_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local session
    (tests) may run without it, and then gets a temporary folder; a cluster raises.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set(SETTING, named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and any
    executor can be lost afterwards without recomputing what stands above."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``__id`` and ``__salt``, which name a document even where its id is null.

    Rows that share an id share a key; rows without an id are told apart by their text.
    """
    bare = F.col(id_col).isNull()
    return df.withColumns({
        "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long")),
        "__salt": F.when(bare, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(1))).otherwise(F.lit(0).cast("long")),
    })


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns named in ``own`` and all others in one struct, ``payload``, so that no name of theirs can
    clash with a column that an operator adds. Undone by ``unpacked``."""
    others = [c for c in docs.columns if c not in own]
    return docs.select(*[F.col(f"`{c}`") for c in own], F.struct(F.lit(True).alias(_SPARE), *[F.col(f"`{c}`") for c in others]).alias("payload"))


def unpacked(df: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """The columns as they were before ``packed``, in their order; those in ``own`` are taken as they are now."""
    return df.select(*[F.col(c) if c in own else F.col(f"payload.`{c}`").alias(c) for c in columns])


def with_text_key(df: DataFrame) -> DataFrame:
    """Add ``__bare``, ``__id`` and ``__text``, which name a document by its id (whether it is null, and which) and a hash
    of its text: rows that repeat an id are one document only if their texts are equal."""
    return df.withColumns({
        "__bare": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")),
        "__text": F.xxhash64(F.coalesce("text", F.lit(""))),
    })


def one_of_each(df: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key."""
    w = Window.partitionBy(*key).orderBy(F.lit(1))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves the given remainder."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def crc_share(id_col: str, share: float) -> Column:
    """A deterministic sample: about the given share of ids, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)


def release(spark: SparkSession) -> None:
    """Delete what this application has stored in the shared folder. Call it once all results are written:
    frames returned by the operators read from there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
