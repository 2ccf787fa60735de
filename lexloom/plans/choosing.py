"""Queries of the choice of files, of filters, and of builds and their samples."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.keys import plain_key, plain_label, tidy
from lexloom.functions.periods import home_day
from lexloom.operators import cdc, choice
from lexloom.operators.filters import LawFilter, has_all_words, in_scopes
from lexloom.plans.shared import plain_sql
from lexloom.tables import table

TODAY = date(2026, 1, 15)


def _label(column: str = "language"):
    label = plain_label(F.col(column))
    return F.when(label.isin("english", "eng", "en"), "ENGLISH").when(label.isin("sinhala", "sin", "si"), "SINHALA").when(label.isin("tamil", "tam", "ta"), "TAMIL")


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Pins and held files are those of documents; listings without title and language are rejected; one without a key takes that of the first listing with its address."""
    listings = table(spark, folder, "listings").withColumn("label", _label())
    documents = table(spark, folder, "documents")
    pins = documents.where(tidy(F.col("chosen_by")) == "pin").where("listing_id is not null").select(plain_key(F.col("doc_key")).alias("doc_key"), F.col("listing_id").alias("listing"))
    held = documents.where("listing_id is not null and sha256 is not null").select(F.col("listing_id").alias("listing"))
    rejects = listings.where("title is null and language is null").select(F.col("id").alias("listing"))
    named = listings.where("listed_key is not null").groupBy("source_url").agg(F.min_by("listed_key", "id").alias("key"))
    rekeys = listings.where("listed_key is null").join(named, "source_url").select(F.col("id").alias("listing"), "key")
    return choice.candidates(listings, table(spark, folder, "sources"), held, pins, rejects, rekeys)


def candidates_with_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each candidate of a document after pins, rejects and rekeys."""
    ranked = _ranked(spark, folder)
    return ranked.select("doc_key", "id", "held", F.row_number().over(Window.partitionBy("doc_key").orderBy("place_by")).alias("place"))


def choose_files(spark: SparkSession, folder: str) -> DataFrame:
    return choice.choose(_ranked(spark, folder))


def relevant_listings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "listings").select("id", choice.names_law(F.col("title")).alias("is_law"))


def years_due(spark: SparkSession, folder: str) -> DataFrame:
    return choice.years_due(table(spark, folder, "docs").select(F.col("doc_year").alias("year")), 1950, TODAY)


def sniffed_files(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return table(spark, folder, "documents").select("doc_id", choice.sniffed(text).alias("kind"), choice.content_address(text).alias("stored_at"))


def cross_source_suppressed(spark: SparkSession, folder: str) -> DataFrame:
    return choice.suppressed(table(spark, folder, "listings"), table(spark, folder, "sources"))


def canonical_listings(spark: SparkSession, folder: str) -> DataFrame:
    return choice.canonical_rows(table(spark, folder, "listings"))


def seeded_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A title for each key, from the built documents, else from documents, else from listings."""
    docs = table(spark, folder, "docs").select("doc_key", "title", F.lit(0).cast("long").alias("n"))
    documents = table(spark, folder, "documents").select("doc_key", "title", F.col("doc_id").alias("n"))
    listings = table(spark, folder, "listings").select(plain_key(F.col("listed_key")).alias("doc_key"), "title", F.col("id").alias("n"))
    return choice.seeded([docs, documents, listings], "doc_key", "n").select("doc_key", "title")


def to_extract_again(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a file but no text, but for those whose file another document has read."""
    rows = table(spark, folder, "documents").where("sha256 is not null")
    blank = ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    return rows.where(blank).select("doc_id", "sha256").join(rows.where(~blank).select("sha256"), "sha256", "left_anti").select("doc_id")


def merged_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Listings upserted by source and address: later rows win, their JSON is laid over the earlier, and only what changed is written."""
    rows = table(spark, folder, "listings").select("source", "source_url", "title", "listing", "id")
    half = F.col("id") % 2 == 0
    out = cdc.merge_upsert(rows.where(half), rows.where(~half), ["source", "source_url"], "id", "listing")
    return out.groupBy("source", "change").agg(F.count("*").alias("rows"), F.min("id").alias("first_id"))


def filter_laws(spark: SparkSession, folder: str) -> DataFrame:
    asked = LawFilter(kinds=("act", "ordinance"), only="laws", year_from=1950.9, year_to=1999)
    courts = LawFilter(only="supremeCourt")
    docs = table(spark, folder, "docs")
    on = lambda f: f.column(F.col("doc_key"), F.col("kind"), F.col("doc_year"))
    return docs.where(on(asked) | on(courts)).select("doc_key", on(courts).alias("supreme"))


def filter_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "docs").where(has_all_words(F.col("title"), "Act (special no. 1")).select("doc_key", "title")


def scoped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Customers that a scope allows: their segment or nation is among those asked for."""
    scopes = F.array(F.concat(F.lit("segment:"), "c_mktsegment"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")))
    return table(spark, folder, "customer").select("c_custkey", in_scopes(scopes, ["segment:BUILDING", "nation:3"]).alias("allowed"), in_scopes(scopes, []).alias("closed"))


def build_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """What a document's build depends on, as one hash: its file, its kind and the version of the rules."""
    parts = F.concat_ws("\u0001", F.coalesce("sha256", F.lit("-")), "kind", F.lit("rules-2"), F.coalesce(F.col("doc_year").cast("string"), F.lit("-")))
    return table(spark, folder, "docs").select("doc_key", F.sha1(parts).alias("build"))


def corpus_state(spark: SparkSession, folder: str) -> DataFrame:
    """One hash of all documents and their states: the hash of the hashes of 256 shards, so that no row holds them all."""
    lines = table(spark, folder, "docs").select(F.concat_ws("\t", "doc_key", F.coalesce("fingerprint", F.lit(""))).alias("line"))
    shards = lines.groupBy(F.substring(F.md5("line"), 1, 2).alias("shard")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("hash"))
    return shards.agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", "hash"))), lambda s: s["hash"]), "\n")).alias("state"), F.count("*").alias("shards"))


def gold_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty documents drawn by a seeded hash, but for those that were tuned on: the sample is the feature, and its size its parameter."""
    docs = table(spark, folder, "docs")
    tuned = docs.where("removed_at is not null").select("doc_key")
    draw = F.md5(F.concat(F.lit("seed-7|"), "doc_key"))
    return docs.join(tuned, "doc_key", "left_anti").select("doc_key", draw.alias("draw")).orderBy("draw").limit(20)


def label_context(spark: SparkSession, folder: str) -> DataFrame:
    """Each schedule with the chunks before and after it in its document."""
    chunks = table(spark, folder, "chunks").where("removed_at is null")
    # Only documents with a schedule are put in order.
    wanted = chunks.where("kind = 'schedule'").select("doc_key").distinct()
    order = Window.partitionBy("doc_key").orderBy("seq", "id")
    near = chunks.join(wanted, "doc_key", "left_semi").select("id", "kind", F.lag("id").over(order).alias("before"), F.lead("id").over(order).alias("after"))
    return near.where("kind = 'schedule'").drop("kind")


def home_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's home day, the day 30 days on, and whether it was due by a day."""
    day = home_day(F.col("o_orderdate"))
    return table(spark, folder, "orders").groupBy(day.alias("day")).agg(F.count("*").alias("orders")).select("day", F.date_add("day", 30).alias("due"), (F.date_add("day", 30) < F.lit("1999-01-01").cast("date")).alias("overdue"), "orders")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    candidates_with_overrides, choose_files, relevant_listings, years_due, sniffed_files, cross_source_suppressed, canonical_listings, seeded_keys, to_extract_again, merged_upsert, filter_laws, filter_words, scoped_rows,
    build_fingerprints, corpus_state, gold_sample, label_context, home_calendar)}

_RANKED = f"""
pins AS (SELECT DISTINCT {plain_sql('doc_key')} AS doc_key, listing_id AS id FROM documents WHERE lower(trim(chosen_by)) = 'pin' AND listing_id IS NOT NULL),
held AS (SELECT DISTINCT listing_id AS id FROM documents WHERE listing_id IS NOT NULL AND sha256 IS NOT NULL),
named AS (SELECT source_url, arg_min(listed_key, id) AS key FROM listings WHERE listed_key IS NOT NULL GROUP BY source_url),
w AS (SELECT l.*, coalesce(l.listed_key, n.key) AS own FROM listings l LEFT JOIN named n ON n.source_url = l.source_url AND l.listed_key IS NULL WHERE NOT (l.title IS NULL AND l.language IS NULL)),
c AS (SELECT w.id, {plain_sql('own')} AS doc_key, CASE WHEN lower(trim(language)) IN ('english', 'eng', 'en') THEN 0 WHEN lower(trim(language)) IN ('sinhala', 'sin', 'si') THEN 1 WHEN lower(trim(language)) IN ('tamil', 'tam', 'ta') THEN 2 ELSE 3 END AS lang,
  coalesce(s.trust, 1 << 30) AS trust, w.id IN (SELECT id FROM held) AS held, file_format IS NULL AS no_file FROM w LEFT JOIN sources s USING (source) WHERE own IS NOT NULL),
r AS (SELECT c.doc_key, c.id, c.held, c.lang, row_number() OVER (PARTITION BY c.doc_key ORDER BY p.id IS NULL, lang, trust, NOT held, no_file, c.id) AS place FROM c LEFT JOIN pins p ON p.doc_key = c.doc_key AND p.id = c.id)"""

ORACLE: dict[str, str] = {
    "candidates_with_overrides": f"WITH {_RANKED} SELECT doc_key, id, held, place FROM r",
    "choose_files": f"""WITH {_RANKED}, h AS (SELECT doc_key, arg_min(id, place) FILTER (WHERE held) AS chosen, arg_min(lang, place) FILTER (WHERE held) AS lang, arg_min(id, place) FILTER (WHERE NOT held) AS first FROM r GROUP BY doc_key),
b AS (SELECT r.doc_key, arg_min(r.id, r.lang * 1000000 + r.place) AS better FROM r JOIN h ON h.doc_key = r.doc_key AND r.lang < h.lang WHERE NOT r.held GROUP BY r.doc_key)
SELECT h.doc_key, chosen, CASE WHEN chosen IS NULL THEN first ELSE better END AS fetch FROM h LEFT JOIN b USING (doc_key)""",
    "relevant_listings": r"SELECT id, coalesce(regexp_matches(title, '(?i)\b(acts?|ordinances?|laws?|statutes?|code|constitution|bill)\b') AND NOT regexp_matches(title, '(?i)\b(gazettes?|notifications?|notices?|regulations?|orders?|by-laws?|vacanc(?:y|ies)|tenders?|auctions?)\b'), false) AS is_law FROM listings",
    "years_due": "SELECT CAST(y AS INT) AS year FROM range(1950, 2027) t(y) WHERE y NOT IN (SELECT doc_year FROM docs WHERE doc_year IS NOT NULL) OR y IN (2025, 2026)",
    "sniffed_files": "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN NULL WHEN starts_with(ltrim(text[1:64]), '%PDF') THEN 'pdf' WHEN starts_with(ltrim(text[1:64]), '<') THEN 'html' ELSE 'other' END AS kind, sha256(text)[1:2] || '/' || sha256(text) AS stored_at FROM documents",
    "cross_source_suppressed": f"WITH k AS (SELECT l.id, {plain_sql('l.listed_key')} AS doc_key, s.trust FROM listings l LEFT JOIN sources s USING (source)) SELECT id, doc_key FROM k WHERE coalesce(trust > 1, true) AND doc_key IN (SELECT doc_key FROM k WHERE trust <= 1 AND doc_key IS NOT NULL)",
    "canonical_listings": "WITH v AS (SELECT id, listing->>'$.record' AS value FROM listings) SELECT v.id, f.canonical FROM v JOIN (SELECT value, min(id) AS canonical FROM v WHERE value IS NOT NULL GROUP BY value) f USING (value) WHERE v.id <> f.canonical",
    "seeded_keys": f"WITH u AS (SELECT doc_key, title, 0 AS part, 0 AS n FROM docs UNION ALL SELECT doc_key, title, 1, doc_id FROM documents UNION ALL SELECT {plain_sql('listed_key')}, title, 2, id FROM listings) SELECT doc_key, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY part, n) AS place FROM u WHERE doc_key IS NOT NULL) WHERE place = 1",
    "to_extract_again": r"WITH d AS (SELECT doc_id, sha256, coalesce(regexp_matches(text, '\S'), false) AS full_text FROM documents WHERE sha256 IS NOT NULL) SELECT doc_id FROM d WHERE NOT full_text AND sha256 NOT IN (SELECT sha256 FROM d WHERE full_text)",
    "merged_upsert": """
WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_url ORDER BY id DESC) AS p FROM listings WHERE id % 2 = 0) WHERE p = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_url ORDER BY id DESC) AS p FROM listings WHERE id % 2 <> 0) WHERE p = 1),
m AS (SELECT coalesce(n.source, o.source) AS source, coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept'
  WHEN n.title IS NOT DISTINCT FROM o.title AND coalesce(n.listing->>'$.record', o.listing->>'$.record') IS NOT DISTINCT FROM o.listing->>'$.record' AND coalesce(n.listing->>'$.description', o.listing->>'$.description') IS NOT DISTINCT FROM o.listing->>'$.description' AND coalesce(n.listing->>'$.pages', o.listing->>'$.pages') IS NOT DISTINCT FROM o.listing->>'$.pages' AND n.id = o.id THEN 'same' ELSE 'changed' END AS change
  FROM o FULL OUTER JOIN n ON o.source = n.source AND o.source_url = n.source_url)
SELECT source, change, count(*) AS rows, min(id) AS first_id FROM m GROUP BY ALL""",
    "filter_laws": "SELECT doc_key, doc_key LIKE 'sc:%' AS supreme FROM docs WHERE (kind IN ('act', 'ordinance') AND regexp_matches(doc_key, '^(act:|law:|ordinance:|cap:|cap1956:|amendment:|constitution)') AND doc_year BETWEEN 1950 AND 1999) OR doc_key LIKE 'sc:%'",
    "filter_words": "SELECT doc_key, title FROM docs WHERE contains(lower(title), 'act') AND contains(lower(title), '(special') AND contains(lower(title), 'no.') AND contains(lower(title), '1')",
    "scoped_rows": "SELECT c_custkey, c_mktsegment = 'BUILDING' OR c_nationkey = 3 AS allowed, false AS closed FROM customer",
    "build_fingerprints": "SELECT doc_key, sha1(coalesce(sha256, '-') || chr(1) || kind || chr(1) || 'rules-2' || chr(1) || coalesce(CAST(doc_year AS VARCHAR), '-')) AS build FROM docs",
    "corpus_state": "WITH l AS (SELECT doc_key || chr(9) || coalesce(fingerprint, '') AS line FROM docs), s AS (SELECT md5(line)[1:2] AS shard, md5(string_agg(line, chr(10) ORDER BY line)) AS hash FROM l GROUP BY 1) SELECT md5(string_agg(hash, chr(10) ORDER BY shard)) AS state, count(*) AS shards FROM s",
    "gold_sample": "SELECT doc_key, md5('seed-7|' || doc_key) AS draw FROM docs WHERE removed_at IS NULL ORDER BY draw LIMIT 20",
    "label_context": "SELECT id, before, after FROM (SELECT id, kind, lag(id) OVER w AS before, lead(id) OVER w AS after FROM chunks WHERE removed_at IS NULL WINDOW w AS (PARTITION BY doc_key ORDER BY seq, id)) WHERE kind = 'schedule'",
    "home_calendar": "SELECT day, CAST(day + INTERVAL 30 DAY AS DATE) AS due, day + INTERVAL 30 DAY < DATE '1999-01-01' AS overdue, orders FROM (SELECT CAST(timezone('Asia/Colombo', timezone('UTC', o_orderdate)) AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1)",
}
