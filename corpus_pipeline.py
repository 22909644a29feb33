"""A corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.decontamination import drop_contaminated
from marginalia.llm.line_dedup import dedup_lines
from marginalia.llm.mixing import mix_documents
from marginalia.llm.near_copies import WIDTH, drop_near_copies
from marginalia.llm.shared import stored, table
from marginalia.llm.simhash import drop_near_duplicates
from marginalia.llm.toxicity import learn, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon finds toxic go."""
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, lexicon).where("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in one of them; n_chars is counted anew."""
    return dedup_lines(docs).selectExpr("doc_id", "text", "lang", "source", "cast(char_length(text) as bigint) AS n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash over five-word shingles first, then what it misses of those of similarity 0.8 or more."""
    return drop_near_copies(stored(drop_near_duplicates(docs, WIDTH), "simhash-kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents chosen for the mix, with the number of epochs of each."""
    return mix_documents(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: Toxicity is learned from labels, which SQL can't express; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
