"""The thin opN queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.ann import nearest
from marginalia.llm.collocations import collocations
from marginalia.llm.decontamination import contamination
from marginalia.llm.html_extract import extract_text, text_length
from marginalia.llm.language_id import identify_language, learn_dictionaries
from marginalia.llm.line_dedup import dedup_lines
from marginalia.llm.mixing import mix_documents
from marginalia.llm.periodic_runs import periodic_runs
from marginalia.llm.pii import KINDS, personal_data
from marginalia.llm.shared import held_out, table
from marginalia.llm.simhash import near_duplicates
from marginalia.llm.substring_dedup import repeated_spans
from marginalia.llm.toxicity import learn, score_toxicity
from marginalia.llm.warc import archive_round_trip


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each passage that several documents hold, with what the cut leaves of a document that loses it."""
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "first_doc_id", F.col("start").cast("string").alias("span_start"), F.col("end").cast("string").alias("span_end"), "is_first", "bytes_dropped", "kept_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, lexicon).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text_length(extract_text(table(spark, sf_dir, "pages")))
    return out.select("page_id", "url", "text", "n_chars")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = learn_dictionaries(docs.where(~held_out("doc_id", 3, 1)))
    out = identify_language(docs.select("doc_id", "text"), known)
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("__id", "__text")


def replayed(docs: DataFrame) -> DataFrame:
    """The texts that op11's contract searches: where crc32 of the id ends in 0, words from g % n on repeat with a period."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    hashed = F.crc32(F.col("doc_id").cast("string"))
    hot = docs.where(hashed % 10 == 0).select("doc_id", words.alias("w"), F.floor(hashed / 10).alias("g")).withColumn("n", F.size("w"))
    at = hot.withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = at.select("doc_id", F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')").alias("text"))
    return docs.where(F.coalesce(hashed % 10 != 0, F.lit(True))).select("doc_id", "text").unionByName(again)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(replayed(table(spark, sf_dir, "documents")))
    greater = "x.length * best.period > best.length * x.period"  # of equal ones the first by start and period stays
    best = F.expr(f"aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (best, x) -> if(best is null or {greater}, x, best))")
    listed = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda name: F.expr(f"array_join(transform({name}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")
    counts = [F.expr(f"cast(size(filter(base_spans, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann, op2_warc, op3_mixing, op4_line_dedup, op5_substring_dedup, op6_toxicity, op7_html_extraction, op8_language_id, op9_simhash, op10_decontamination, op11_periodic_runs, op12_collocations, op13_pii)}


WARC_SQL = r"""
WITH sized AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), heads AS (SELECT payload_digest, max(page_id) AS head FROM sized WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, s.payload_digest, CASE WHEN page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM sized s LEFT JOIN heads h ON s.payload_digest = h.payload_digest
"""

LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), heads AS (
  SELECT k, max(doc_id) AS keep_id FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, pos, line, h.k IS NOT NULL AND doc_id <> keep_id AS gone FROM keyed LEFT JOIN heads h ON keyed.k = h.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

DECONTAMINATION_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM wins), places AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, p.n, s, item_id FROM places p JOIN wins USING (n, win)
), words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words ON docs.doc_id = words.doc_id LEFT JOIN found ON docs.doc_id = found.doc_id
"""

MIXING_SQL = r"""
WITH rows AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         'd' || CAST((strpos('0123456789abcdef', md5(coalesce(source, ''))[1:1]) - 1) % 4 AS VARCHAR) AS domain
  FROM documents
), leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST(sum(n_tokens) * 2 AS HUGEINT) AS room FROM rows WHERE n_tokens > 0 GROUP BY ALL
), langs AS (SELECT domain, lang, sum(room) AS room FROM leaves GROUP BY ALL
), domains AS (SELECT domain, sum(room) AS room FROM langs GROUP BY ALL
), b0 AS (
  SELECT domain, domain AS name, room, CASE domain WHEN 'd0' THEN 5 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w,
         (SELECT sum(tokens) * 60 // 100 FROM leaves) AS budget FROM domains
), b1 AS (
  SELECT *, (budget - coalesce(sum(room) OVER (ORDER BY room / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
            >= room * sum(w) OVER (ORDER BY room / w, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS isfull FROM b0
), b2 AS (
  SELECT domain, CAST(CASE WHEN isfull THEN room ELSE (budget - coalesce(sum(room) FILTER (WHERE isfull) OVER (), 0)) * w // sum(w) FILTER (WHERE NOT isfull) OVER () END AS HUGEINT) AS budget FROM b1
), l0 AS (
  SELECT domain, lang, lang AS name, room, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w, budget FROM langs JOIN b2 USING (domain)
), l1 AS (
  SELECT *, (budget - coalesce(sum(room) OVER (PARTITION BY domain ORDER BY room / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
            >= room * sum(w) OVER (PARTITION BY domain ORDER BY room / w, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS isfull FROM l0
), l2 AS (
  SELECT domain, lang, CAST(CASE WHEN isfull THEN room ELSE (budget - coalesce(sum(room) FILTER (WHERE isfull) OVER (PARTITION BY domain), 0)) * w // sum(w) FILTER (WHERE NOT isfull) OVER (PARTITION BY domain) END AS HUGEINT) AS budget FROM l1
), s0 AS (SELECT domain, lang, source, source AS name, tokens, room, 1 AS w, budget FROM leaves JOIN l2 USING (domain, lang)
), s1 AS (
  SELECT *, (budget - coalesce(sum(room) OVER (PARTITION BY domain, lang ORDER BY room / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
            >= room * sum(w) OVER (PARTITION BY domain, lang ORDER BY room / w, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS isfull FROM s0
), s2 AS (
  SELECT domain, lang, source, tokens, CAST(CASE WHEN isfull THEN room ELSE (budget - coalesce(sum(room) FILTER (WHERE isfull) OVER (PARTITION BY domain, lang), 0)) * w // sum(w) FILTER (WHERE NOT isfull) OVER (PARTITION BY domain, lang) END AS HUGEINT) AS share FROM s1
), keyed AS (
  SELECT rows.*, share // tokens AS epoch, share % tokens AS rest,
         md5('mix:' || CAST(share // tokens AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM rows JOIN s2 USING (domain, lang, source) WHERE n_tokens > 0
), taken AS (
  SELECT *, epoch + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS epochs FROM keyed
)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epochs AS BIGINT) AS epochs FROM taken WHERE epochs > 0
"""


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM words, range(1, 6) t(k) WHERE len(w) >= k)
), counts AS (SELECT lang, k AS size, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 100
), inside AS (
  SELECT lang, array_to_string(w[s:s + k - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, w, f, k, unnest(range(1, size - k + 2)) AS s FROM candidates, range(2, 5) t(k) WHERE k < size) GROUP BY ALL
), own AS (
  SELECT c.* FROM candidates c LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.f
), cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:], ' ') AS p2 FROM (SELECT *, unnest(range(1, size)) AS k FROM own)
), scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.p1 JOIN counts y ON y.lang = c.lang AND y.phrase = c.p2 JOIN totals t ON t.lang = c.lang
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM lowest QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC_SQL, "op3_mixing": MIXING_SQL, "op4_line_dedup": LINE_DEDUP_SQL, "op10_decontamination": DECONTAMINATION_SQL, "op12_collocations": COLLOCATIONS_SQL}
