"""Snapshot scans of a reference library's relational tables, declared as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def top_level_items(t: Tables) -> DataFrame:
    """Items that are no attachment, note or annotation and not deleted."""
    out = t["items"]
    for name in ("itemAttachments", "itemNotes", "itemAnnotations", "deletedItems"):
        if name in t:
            out = out.join(t[name].select("itemID"), "itemID", "left_anti")
    return out


def fields_map(t: Tables) -> DataFrame:
    """(itemID, fields): the entity-attribute-value rows of an item as a map."""
    joined = t["itemData"].join(t["itemDataValues"], "valueID").join(t["fields"], "fieldID")
    w = F.struct("fieldName", "value")
    return joined.dropDuplicates(["itemID", "fieldName"]).groupBy("itemID").agg(F.map_from_entries(F.array_sort(F.collect_list(w))).alias("fields"))


def authors(t: Tables) -> DataFrame:
    """(itemID, authors) in order; a one-field name is all last name."""
    whole = F.col("fieldMode") != 0
    joined = t["itemCreators"].join(t["creators"], "creatorID").join(t["creatorTypes"], "creatorTypeID")
    one = F.struct("orderIndex", F.col("lastName").alias("last"), F.when(whole, "").otherwise(F.coalesce("firstName", F.lit(""))).alias("first"), F.col("creatorType").alias("role"))
    return joined.groupBy("itemID").agg(F.array_sort(F.collect_list(one)).alias("authors"))


def collections_of(t: Tables) -> DataFrame:
    return t["collectionItems"].join(t["collections"], "collectionID").groupBy("itemID").agg(F.array_sort(F.collect_list("collectionName")).alias("collections"), F.array_sort(F.collect_list("key")).alias("collection_keys"))


def tags_of(t: Tables) -> DataFrame:
    return t["itemTags"].join(t["tags"], "tagID").groupBy("itemID").agg(F.array_sort(F.collect_list("name")).alias("tags"))


def attachments(t: Tables, storage: str = "storage") -> DataFrame:
    """Attachments with their title and path: ``storage:`` paths lie in the folder of the attachment's key. Deleted ones are left out."""
    a = t["itemAttachments"].join(t["items"].select("itemID", "key"), "itemID")
    if "deletedItems" in t:
        a = a.join(t["deletedItems"].select("itemID"), "itemID", "left_anti")
    titles = fields_map(t).select("itemID", F.col("fields")["title"].alias("title"))
    inner = F.col("path").startswith("storage:")
    return a.join(titles, "itemID", "left").select("itemID", F.col("parentItemID"), "title", "contentType", "linkMode", F.when(inner, F.concat(F.lit(f"{storage}/"), "key", F.lit("/"), F.substring("path", 9, 4096))).otherwise(F.col("path")).alias("path"))


def notes(t: Tables) -> DataFrame:
    """(itemID, parentItemID, title, markdown, images): notes as markdown, with how many images are embedded; deleted ones are left out."""
    from marginalia.functions.text import embedded_images, html_to_markdown

    n = t["itemNotes"]
    if "deletedItems" in t:
        n = n.join(t["deletedItems"].select("itemID"), "itemID", "left_anti")
    return n.select("itemID", "parentItemID", "title", html_to_markdown(F.col("note")).alias("markdown"), embedded_images(F.col("note")).alias("images"))


def annotations(t: Tables) -> DataFrame:
    """Annotations by parent and page label; the label sorts by its numeric beginning."""
    from marginalia.functions.scalars import number_prefix

    return t["itemAnnotations"].withColumn("page_order", number_prefix(F.col("pageLabel"))).orderBy("parentItemID", "page_order", "itemID")


def merge_relations(t: Tables, predicate: str = "dc:replaces") -> DataFrame:
    """(old_key, new_key) from relation URIs that end in ``/items/<KEY>``; others are skipped."""
    rel = t["itemRelations"].join(t["relationPredicates"].where(F.col("predicate") == predicate), "predicateID").join(t["items"].select("itemID", F.col("key").alias("new_key")), "itemID")
    parts = F.split("object", "/")
    return rel.where(F.get(parts, F.size(parts) - 2) == "items").select(F.get(parts, F.size(parts) - 1).alias("old_key"), "new_key").where("old_key <> ''")


def merge_counts(t: Tables, predicate: str = "dc:replaces") -> DataFrame:
    """One row (relations, used, skipped): skipped ones name no item of a library, or none that is there."""
    total = t["itemRelations"].join(t["relationPredicates"].where(F.col("predicate") == predicate), "predicateID").agg(F.count("*").alias("relations"))
    used = merge_relations(t, predicate).agg(F.count("*").alias("used"))
    return total.join(F.broadcast(used), F.lit(True)).withColumn("skipped", F.col("relations") - F.col("used"))


def collection_tree(t: Tables) -> DataFrame:
    counts = t["collectionItems"].groupBy("collectionID").agg(F.count("*").alias("n_items"))
    return t["collections"].join(counts, "collectionID", "left").select("collectionID", "key", "collectionName", "parentCollectionID", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def load_items(t: Tables) -> DataFrame:
    """One nested row an item: fields, authors, collections, tags, and attachments, notes and annotations where their tables are given.

    Annotations come from an item's attachments, in the order of their pages.
    """
    out = top_level_items(t).join(t["itemTypes"], "itemTypeID", "left")
    for part in (fields_map(t), authors(t), collections_of(t), tags_of(t)):
        out = out.join(part, "itemID", "left")
    listed = lambda name, *columns: F.array_sort(F.collect_list(F.struct(*columns))).alias(name)
    if "itemAttachments" in t:
        files = attachments(t)
        out = out.join(files.groupBy(F.col("parentItemID").alias("itemID")).agg(listed("attachments", F.col("itemID").alias("id"), "title", "contentType", "path")), "itemID", "left")
        if "itemAnnotations" in t:
            of = annotations(t).join(files.select(F.col("itemID").alias("parentItemID"), F.col("parentItemID").alias("__item")), "parentItemID")
            out = out.join(of.groupBy(F.col("__item").alias("itemID")).agg(listed("annotations", "page_order", F.col("itemID").alias("id"), F.col("pageLabel").alias("page"), "text", "comment")), "itemID", "left")
    if "itemNotes" in t:
        out = out.join(notes(t).where("parentItemID IS NOT NULL").groupBy(F.col("parentItemID").alias("itemID")).agg(listed("notes", F.col("itemID").alias("id"), "title", "markdown")), "itemID", "left")
    return out


def choose_text(verdict, cache_chars, parsed_chars, mode: str = "auto"):
    """Which of two candidate texts serves: cache or parsed. off trusts the cache, deep prefers the longer, auto goes by the verdict."""
    some, better = F.coalesce(parsed_chars, F.lit(0)) > 0, F.coalesce(parsed_chars, F.lit(0)) > F.coalesce(cache_chars, F.lit(0))
    if mode == "off":
        return F.when(F.coalesce(cache_chars, F.lit(0)) > 0, "cache").otherwise("parsed")
    if mode == "deep":
        return F.when(better, "parsed").otherwise("cache")
    return F.when(verdict == "ok", "cache").when((verdict == "bad") & some, "parsed").when((verdict == "unsure") & better, "parsed").otherwise("cache")
