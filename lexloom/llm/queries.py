"""Queries of the problems of training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.keys import plain_key, tidy
from lexloom.llm.groups import components
from lexloom.llm.languages import languages_of, wrong_labels
from lexloom.llm.leaks import leaked, leaks, reworded
from lexloom.llm.scans import repaired
from lexloom.llm.splitting import split_texts
from lexloom.llm.survivors import claims, survivors, truth_discovery
from lexloom.llm.tokens import token_ids
from lexloom.llm.truncation import by_source, truncated
from lexloom.plans.dealt import NORMS
from lexloom.plans.shared import plain_sql
from lexloom.tables import table


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(table(spark, folder, "chunks"), table(spark, folder, "size_limits"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split_texts(table(spark, folder, "chunks"), table(spark, folder, "size_limits"), keep_whole=False)
    return pieces.where("piece = 1").select("id", "how")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return wrong_labels(languages_of(table(spark, folder, "listings")))


def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment of every listing with its language and a confidence."""
    told = languages_of(table(spark, folder, "listings"))
    return told.select("id", F.posexplode("segments").alias("segment", "s")).select("id", "segment", "s.text", "s.language", "s.confidence")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors(table(spark, folder, "listings"), table(spark, folder, "sources"), table(spark, folder, "documents")).drop("listings")


def p3_truth(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving record of each document as voted by the sources, weighted by their reliability."""
    best, _ = truth_discovery(claims(table(spark, folder, "listings"), table(spark, folder, "sources")))
    value = lambda field: F.max(F.when(F.col("field") == field, F.col("value"))).alias(field)
    return best.groupBy("doc_key").agg(value("title"), value("date"), value("language"))


def p3_reliability(spark: SparkSession, folder: str) -> DataFrame:
    _, known = truth_discovery(claims(table(spark, folder, "listings"), table(spark, folder, "sources")))
    return known.select("source", F.round("reliability", 3).alias("reliability"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")))


def p9_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a passage whose numbers, names or units are changed throughout."""
    return reworded(leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = repaired(table(spark, folder, "chunks"), table(spark, folder, "docs"), with_text=False)
    return found.select("id", F.explode("noise").alias("noise")).distinct()


def p5_text(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks as continuous paragraphs."""
    return repaired(table(spark, folder, "chunks"), table(spark, folder, "docs")).select("id", "text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "links").where(tidy(F.col("kind")) == "same_as")
    pairs = links.select(plain_key(F.col("src_doc")).alias("a"), plain_key(F.col("dst_doc")).alias("b"))
    return components(pairs, "a", "b").select(F.col("member").alias("doc_key"), F.col("group").alias("group_key"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(table(spark, folder, "documents")).where("cut").select("doc_id").distinct()


def p10_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return by_source(truncated(table(spark, folder, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_segments": p2_segments,
    "p3_found": p3_found,
    "p3_truth": p3_truth,
    "p3_reliability": p3_reliability,
    "p5_found": p5_found,
    "p5_text": p5_text,
    "p6_found": p6_found,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_templates": p9_templates,
    "p10_found": p10_found,
    "p10_by_source": p10_by_source,
}

ORACLE: dict[str, str] = {
    "p3_found": rf"""
WITH {NORMS},
pins AS (SELECT DISTINCT {plain_sql('doc_key')} AS doc_key, listing_id FROM documents WHERE lower(trim(chosen_by)) = 'pin'),
k AS (SELECT DISTINCT n.id, {plain_sql('listed_key')} AS doc_key, n.last_seen, coalesce(n.trust, 1 << 30) AS trust, CASE WHEN lower(trim(language)) IN ('english', 'eng', 'en') THEN 1 WHEN lower(trim(language)) IN ('sinhala', 'sin', 'si') THEN 2 WHEN lower(trim(language)) IN ('tamil', 'tam', 'ta') THEN 3 ELSE 4 END AS lang,
  title IS NOT NULL AND lower(trim(title)) NOT IN ('', '-', 'n/a', '(no title)', 'untitled') AS titled, coalesce(norm <> 'none', false) AS dated FROM n WHERE listed_key IS NOT NULL),
r AS (SELECT k.*, row_number() OVER (PARTITION BY k.doc_key ORDER BY p.listing_id IS NOT NULL DESC, lang, trust, last_seen DESC NULLS LAST, id DESC) AS place FROM k LEFT JOIN pins p ON p.doc_key = k.doc_key AND p.listing_id = k.id)
SELECT doc_key, arg_min(id, place) AS listing_id, coalesce(arg_min(id, place) FILTER (WHERE titled), 0) AS title_from, coalesce(arg_min(id, place) FILTER (WHERE dated), 0) AS date_from FROM r GROUP BY doc_key HAVING count(DISTINCT id) > 1
""",
    "p1_found": r"""
SELECT c.id, CASE WHEN list_max(list_transform(regexp_split_to_array(c.text, '[ \t\r\n\x{a0}]+'), lambda w: length(w))) > l.max_chars THEN 'hard' ELSE 'natural' END AS how
FROM chunks c JOIN size_limits l ON l.kind = coalesce(c.kind, '*') WHERE length(c.text) > l.max_chars
""",
    "p9_found": r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'i', item_id, passage FROM eval_items),
n AS (SELECT side, id, list_filter(string_split_regex(regexp_replace(lower(t), '[^\p{L}\p{M}\p{Nd}\s]', '', 'g'), '\s+'), lambda x: x <> '') AS ws FROM w WHERE t IS NOT NULL),
g AS (SELECT side, id, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS gram FROM n WHERE len(ws) >= 13)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON i.gram = d.gram WHERE d.side = 'd' AND i.side = 'i'
""",
    "p6_found": r"""
WITH RECURSIVE e0 AS (
  SELECT CASE WHEN regexp_matches(s0, '^gazette:[0-9]+/[0-9]$') THEN replace(s0, '/', '/0') ELSE s0 END AS s,
    CASE WHEN regexp_matches(d0, '^gazette:[0-9]+/[0-9]$') THEN replace(d0, '/', '/0') ELSE d0 END AS d
  FROM (SELECT regexp_replace(lower(regexp_replace(src_doc, '\s+', '', 'g')), '(^|[^0-9])0+([0-9])', '\1\2', 'g') AS s0,
    regexp_replace(lower(regexp_replace(dst_doc, '\s+', '', 'g')), '(^|[^0-9])0+([0-9])', '\1\2', 'g') AS d0
    FROM links WHERE lower(trim(kind)) = 'same_as')),
e AS (SELECT s, d FROM e0 UNION SELECT d, s FROM e0 UNION SELECT s, s FROM e0 UNION SELECT d, d FROM e0),
walk AS (SELECT s AS doc_key, d AS reached FROM e UNION SELECT w.doc_key, e.d FROM walk w JOIN e ON e.s = w.reached)
SELECT doc_key, min(reached) AS group_key FROM walk GROUP BY doc_key
""",
}
