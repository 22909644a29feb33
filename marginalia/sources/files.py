"""Readers and writers for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marginalia.functions.text import strip

EVENT = T.StructType([
    T.StructField("session", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("source", T.StructType([T.StructField("kind", T.StringType())])),
        T.StructField("content", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))),
        T.StructField("message", T.StructType([T.StructField("content", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])))])),
        T.StructField("name", T.StringType()),
    ])),
])


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | T.StructType | None = None, **options) -> DataFrame:
    """Parquet, ORC, CSV, JSON, text or JDBC through Spark's readers; text formats need a schema rather than inference."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Session events, JSON lines (compressed or not); lines that can't be read are dropped."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path).where("seq IS NOT NULL")


LAYOUT = "struct<pages:array<struct<blocks:array<struct<type:string,content:string,level:int,captions:array<string>,image_source:string>>>>>"
FINGERPRINT = "path string, length long, modified timestamp, hash string"
HASH_CHARS = 16


def _doc(path: str):
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def layout_blocks(files: DataFrame) -> DataFrame:
    """(doc, page, pos, type, content, level, caption, image) from files (path, content), a layout as JSON each. A file that can't be read
    as such gives no block."""
    docs = files.select(_doc("path").alias("doc"), F.from_json(F.decode("content", "UTF-8"), LAYOUT).alias("d"))
    pages = docs.select("doc", F.posexplode("d.pages").alias("p", "pg"))
    blocks = pages.select("doc", (F.col("p") + 1).alias("page"), F.posexplode("pg.blocks").alias("pos", "b"))
    return blocks.select("doc", "page", "pos", "b.type", "b.content", "b.level", F.array_join(F.coalesce("b.captions", F.array().cast("array<string>")), " ").alias("caption"), F.col("b.image_source").alias("image"))


def _found(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_layout(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """All layouts of a folder as blocks."""
    return layout_blocks(_found(spark, path, pattern))


def changed_files(spark: SparkSession, path: str, known: DataFrame, pattern: str = "*.json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changed, seen, gone): files whose content differs from what is known, with path, content and hash; the fingerprints of all
    files as they are now (see FINGERPRINT); and the paths that are no longer there.

    Files of a known length and time are taken for unchanged and not opened; the others are, and count as changed only if their hash differs. Contents
    are read by one scan that leaves out files older than all those to be opened.
    """
    now = _found(spark, path, pattern).select("path", "length", F.col("modificationTime").alias("modified"))
    old = known.select("path", F.col("length").alias("__length"), F.col("modified").alias("__modified"), F.col("hash").alias("__hash"))
    compared = now.join(old, "path", "left")
    same = F.col("length").eqNullSafe(F.col("__length")) & F.col("modified").eqNullSafe(F.col("__modified"))
    touched = compared.where(~same)
    since = touched.agg(F.min("modified")).first()[0]
    contents = _found(spark, path, pattern)
    contents = contents.where(F.col("modificationTime") >= F.lit(since)) if since is not None else contents.limit(0)
    opened = contents.select("path", "content").join(touched.select("path", "length", "modified", "__hash"), "path").withColumn("hash", F.substring(F.sha1("content"), 1, HASH_CHARS))
    changed = opened.where(~F.col("hash").eqNullSafe(F.col("__hash"))).select("path", "content", "hash")
    seen = compared.where(same).select("path", "length", "modified", F.col("__hash").alias("hash")).unionByName(opened.select("path", "length", "modified", "hash"))
    return changed, seen, known.select("path").join(now, "path", "left_anti")


def refresh_layout(spark: SparkSession, path: str, blocks: DataFrame, known: DataFrame, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(blocks, fingerprints) after changed files were parsed anew: blocks of gone and changed files leave, all others stay unparsed."""
    changed, seen, gone = changed_files(spark, path, known, pattern)
    leave = changed.select(_doc("path").alias("doc")).union(gone.select(_doc("path").alias("doc"))).distinct()
    return blocks.join(leave, "doc", "left_anti").unionByName(layout_blocks(changed)), seen


def split_form_feeds(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    return texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\f")).alias("p", "text")).select(key, (F.col("p") + 1).alias("page"), "text")


def parse_page_anchors(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``## p.N`` markdown to (key, page, text); lines before the first anchor are left out."""
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    n = F.regexp_extract("line", r"^## p\.(\d+)\s*$", 1)
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.withColumn("anchor", F.when(n != "", n.cast("int"))).withColumn("page", F.last("anchor", ignorenulls=True).over(order))
    body = placed.where("page IS NOT NULL AND anchor IS NULL").groupBy(key, "page").agg(strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n")).alias("text"))
    return body


def render_pages(pages: DataFrame, key: str) -> DataFrame:
    """(key, text): pages under their anchors, in order."""
    one = F.struct("page", F.concat(F.lit("## p."), F.col("page").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("t"))
    return pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["t"]), "\n\n").alias("text"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite", kind: str = "parquet") -> None:
    """Dynamic partition overwrite: only the partitions that the frame holds are replaced."""
    w = df.write.format(kind).mode(mode).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Bucketed and sorted by key, so that later joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
