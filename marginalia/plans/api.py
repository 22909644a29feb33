"""The knowledge base as one object: the calls that a user makes, each a DataFrame.

Tables are named frames: items, pages, chunks, vectors, figures, notes, extras, experience,
weights (item_key, pinned, manual), health, merges, tombstones. Writes return new frames; the
caller decides where they are stored (see sources/files.py).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import scalars as sc
from marginalia.operators import chunking, ledger, relational, retrieval, views
from marginalia.plans.search import Index, Search, parse_units, search


@dataclass(frozen=True)
class KnowledgeBase:
    tables: dict[str, DataFrame]
    now_year: int
    embed: object = field(default=None, compare=False)

    def _with(self, **tables: DataFrame) -> KnowledgeBase:
        return replace(self, tables=self.tables | tables)

    def weights(self) -> DataFrame:
        """(item_key, base, multiplier) for every item."""
        t = self.tables
        counts = ledger.ledger_weights(ledger.explode_items(t["experience"]))
        full = counts.join(t["weights"].select("item_key", "pinned", "manual"), "item_key", "full_outer")
        return ledger.multipliers(t["items"], full, t["health"], self.now_year)

    def search(self, query: str, limit: int = 10, collection: str | None = None, year_from: int | None = None, year_to: int | None = None, facets: Column | None = None, whole_documents: bool = False) -> DataFrame:
        keep = sc.year_filter(F.col("year"), year_from, year_to)
        if collection:
            keep = keep & F.array_contains("collections", collection)
        if facets is not None:
            keep = keep & facets
        vector = self.embed(query) if self.embed else None
        known = self.tables.get("postings")
        index = Index(known, retrieval.corpus_size(self.tables["chunks"].where("level = 1")), self.tables.get("term_df")) if known is not None else None
        parents = self.tables["chunks"].where("level = 0").select(F.col("chunk_id").alias("parent_id"), "text")
        return search(self.tables["chunks"].where("level = 1"), self.tables.get("vectors"), self.tables["items"], self.weights(), Search(query, max(1, min(30, limit)), whole_documents=whole_documents), vector, keep, index, parents)

    def related_experience(self, query: str, keys: list[str], limit: int = 20) -> DataFrame:
        return ledger.related(self.tables["experience"], [u for u, _ in parse_units(query)], keys, limit)

    def figures(self, words: str | None = None, kind: str | None = None, key: str | None = None, limit: int = 50) -> DataFrame:
        return views.find_figures(self.tables["figures"], self.tables["items"], words, kind, key, limit)

    def item(self, key: str) -> DataFrame:
        t = self.tables
        return views.item_view(t["items"].where(F.col("item_key") == key), t["extras"], t["figures"], t["notes"], t["experience"])

    def fulltext(self, key: str, low: int = 1, high: int = 10**6, max_chars: int = 20_000) -> DataFrame:
        return views.read_pages(self.tables["pages"], key, low, high, max_chars)

    def experience(self, item: str | None = None, tag: str | None = None, limit: int = 50) -> DataFrame:
        out = self.tables["experience"]
        if item:
            out = out.where(F.array_contains("item_keys", item))
        if tag:
            out = out.where(F.exists("tags", lambda x: F.lower(x) == tag.lower()))
        return out.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)

    def add_experience(self, rows: DataFrame) -> KnowledgeBase:
        """New entries, without repeats, numbered after the last; the weights follow from them."""
        old = self.tables["experience"]
        fresh = ledger.new_entries(rows, old)
        last = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
        return self._with(experience=old.unionByName(ledger.renumber(fresh, ["created_at", "asked"]).withColumn("id", F.col("id") + F.lit(last)), allowMissingColumns=True))

    def set_weight(self, rows: DataFrame) -> KnowledgeBase:
        return self._with(weights=relational.upsert(self.tables["weights"], rows, ["item_key"]))

    def reindex(self) -> KnowledgeBase:
        """Chunks, the keyword index and term statistics anew from items and pages; they are kept, so that queries read them only."""
        t = self.tables
        rows = chunking.collect_chunks(t["items"], chunking.sectionize(t["pages"], "item_key"), annotations=t.get("annotations"), notes=t["notes"].withColumnRenamed("note", "text") if "notes" in t else None)
        number = lambda seq: F.when(F.col(seq).isNotNull(), F.xxhash64("item_key", seq))
        chunks = relational.kept(rows.where("level = 0 OR indexable").withColumns({"chunk_id": number("seq"), "parent_id": number("parent_seq")}))
        indexed = chunks.where("level = 1")
        return self._with(chunks=chunks, postings=relational.kept(retrieval.postings(indexed)), term_df=relational.kept(retrieval.term_df(indexed)))

    def plan_acquisition(self, dois: DataFrame, limit: int = 50) -> DataFrame:
        """Requested DOIs, normalised, with whether an item has them already."""
        have = self.tables["items"].select(sc.normalize_doi(F.col("doi")).alias("doi"), "item_key").where("doi <> ''").dropDuplicates(["doi"])
        return views.preflight(dois, limit).join(have, "doi", "left").orderBy("pos")

    def paper_info(self, dois: DataFrame, sources: list[DataFrame], fields: list[str]) -> DataFrame:
        return views.enrich(dois.withColumn("doi", sc.normalize_doi(F.col("doi"))), "doi", sources, fields)

    def acquisition_progress(self, requests: DataFrame, results: DataFrame) -> DataFrame:
        """Each request with its result, pending without one."""
        return requests.join(results.select("doi", "state"), "doi", "left").withColumn("state", F.coalesce("state", F.lit("pending")))

    def attach(self, files: DataFrame) -> KnowledgeBase:
        """Attachment rows (item_key, path) added to their items' counts; files of unknown items are left out."""
        counts = files.join(self.tables["items"].select("item_key"), "item_key", "left_semi").groupBy("item_key").agg(F.countDistinct("path").alias("__n"))
        items = self.tables["items"].join(counts, "item_key", "left").withColumn("n_pdfs", F.coalesce("n_pdfs", F.lit(0)) + F.coalesce("__n", F.lit(0))).drop("__n")
        return self._with(items=items)

    def stats(self) -> DataFrame:
        t = self.tables
        return views.manifest(t["items"], t["chunks"], t["vectors"])

    def references(self, keys: DataFrame) -> DataFrame:
        t = self.tables
        return relational.reference_status(keys, t["items"].withColumnRenamed("item_key", "key"), t["merges"], t["tombstones"])
