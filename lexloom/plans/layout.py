"""Queries of the operators on lines, spans and levels, and further comparisons of texts and keys."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.keys import plain_key
from lexloom.operators import layout as y
from lexloom.operators.citations import name_index
from lexloom.operators.search import overlap
from lexloom.operators.skew import spread_join
from lexloom.plans.shared import both, plain_sql
from lexloom.sources.files import backup
from lexloom.tables import table


def paragraphs_joined(spark: SparkSession, folder: str) -> DataFrame:
    rows = y.lines(table(spark, folder, "chunks").select("id", "text"), "id", "text")
    return y.joined_paragraphs(rows, "id", "n", "line", 40).select("id", "first", "lines", F.length("text").alias("characters"))


def spans_merged(spark: SparkSession, folder: str) -> DataFrame:
    """When each document was listed, as spans without overlaps."""
    rows = table(spark, folder, "listings").where("listed_key is not null").select(plain_key(F.col("listed_key")).alias("doc_key"), "first_seen", "last_seen")
    return y.merged_spans(rows, "doc_key", "first_seen", "last_seen", "7 days")


def nearest_purchase(spark: SparkSession, folder: str) -> DataFrame:
    """The purchase nearest to each error of the same user, within six hours."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return y.nearest(errors, events.where("event_type = 'purchase'"), "user_id", "ts", "event_id", "6 hours").select("event_id", "near")


def common_quantity(spark: SparkSession, folder: str) -> DataFrame:
    return y.common_value(table(spark, folder, "lineitem").select("l_suppkey", "l_quantity"), "l_suppkey", "l_quantity", 2.0)


def cited_names(spark: SparkSession, folder: str) -> DataFrame:
    """Documents named in running text, by the longest known ending of the words before and with the kind word."""
    phrases = table(spark, folder, "chunks").select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:[A-Za-z()]+ ){1,8}(?:Act|Ordinance)"), F.lit(0)))).alias("words"))
    return y.longest_name(phrases, "id", "words", name_index(table(spark, folder, "docs")))


def page_kinds(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"), (F.col("source").isin("bundle-archive", "oldstatutes")).alias("images"), F.col("lang").isNull().alias("odd"))
    return rows.groupBy(y.page_kind(F.col("n"), F.col("images"), F.col("odd")).alias("kind")).agg(F.count("*").alias("pages"))


def trimmed_keys(spark: SparkSession, folder: str) -> DataFrame:
    slug = F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-")
    return table(spark, folder, "docs").select("doc_key", y.trimmed_key(slug, 40, 31).alias("key"))


def wrong_files(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents print in their first line the number that their key has, or another."""
    head = F.split(F.col("text"), "\n")[0]
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", F.regexp_extract("doc_key", r"^(?:act|law|ordinance):(.*)$", 1).alias("keyed"), F.concat_ws("/", F.nullif(F.regexp_extract(head, r"No\. (\d+) of \d{4}", 1), F.lit("")), F.nullif(F.regexp_extract(head, r"No\. \d+ of (\d{4})", 1), F.lit(""))).alias("printed"))
    state = F.when((F.col("keyed") == "") | (F.col("printed") == ""), "unprinted").when(F.col("keyed") == F.col("printed"), "right").otherwise("wrong")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("documents"), F.max("doc_id").alias("last"))


def title_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """How alike the built title of a document is to that of its last row."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(difflib.SequenceMatcher(None, x, z).ratio(), 6) if x is not None and z is not None else None for x, z in zip(a, b, strict=True)], dtype="float64")

    last = table(spark, folder, "documents").groupBy("doc_key").agg(F.max_by("title", "doc_id").alias("other"))
    return table(spark, folder, "docs").join(last, "doc_key").select("doc_key", ratio("title", "other").alias("ratio"))


def backup_parity(spark: SparkSession, folder: str) -> DataFrame:
    """Tables written as a backup and read again, with the rows of both."""
    out = []
    for name in ("docs", "links", "sources"):
        _, written, back = backup(table(spark, folder, name), name)
        out.append((name, written, back))
    return spark.createDataFrame(out, "name string, written long, back long")


def word_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """The three chunks that share most long words with each question."""
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("query"), F.col("question").alias("words"))
    hits = overlap(table(spark, folder, "chunks"), items, 3, longer=5)
    return hits.select(F.col("query").alias("item_id"), F.col("hit").alias("id"), F.col("score").cast("long").alias("words"), "rank")


def null_safe_twins(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that repeat an earlier one in key, language and listing, nulls alike, with the first of them."""
    same = F.to_json(F.struct("doc_key", "lang", "listing_id"))
    rows = table(spark, folder, "documents").where("doc_key is not null").select("doc_id", same.alias("same"))
    first = rows.groupBy(F.col("same").alias("group")).agg(F.min("doc_id").alias("twin"), F.count("*").alias("rows"))
    return spread_join(rows, first, "same", "rows", ["twin"]).where("twin < doc_id").select("doc_id", "twin")


_last_seen, _last_seen_sql = both("""
SELECT d.doc_key, greatest(max(d.built_at), max(c.built_at), max(d.removed_at)) AS last_at, count(DISTINCT c.id) AS chunks FROM {docs} d LEFT JOIN {chunks} c ON c.doc_key = d.doc_key GROUP BY d.doc_key
""")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "paragraphs_joined": paragraphs_joined, "spans_merged": spans_merged, "nearest_purchase": nearest_purchase, "common_quantity": common_quantity, "cited_names": cited_names, "page_kinds": page_kinds,
    "trimmed_keys": trimmed_keys, "wrong_files": wrong_files, "title_ratio": title_ratio, "backup_parity": backup_parity, "word_overlap": word_overlap, "last_activity": _last_seen, "null_safe_twins": null_safe_twins,
}

ORACLE: dict[str, str] = {
    "cited_names": r"""
WITH k AS (SELECT lower(regexp_extract(title, '^(?:The )?(.*?(?:Act|Law|Ordinance))\b', 1)) AS name, doc_key FROM docs WHERE title IS NOT NULL),
u AS (SELECT name, min(doc_key) AS doc_key FROM k WHERE name <> '' GROUP BY name HAVING min(doc_key) = max(doc_key)),
p AS (SELECT DISTINCT id, words, string_split_regex(lower(words), '\s+') AS w FROM (SELECT id, unnest(regexp_extract_all(text, '(?:[A-Za-z()]+ ){1,8}(?:Act|Ordinance)')) AS words FROM chunks)),
e AS (SELECT id, words, unnest(list_transform(range(1, least(len(w), 12) + 1), lambda n: array_to_string(w[len(w) - n + 1:], ' '))) AS name FROM p)
SELECT id, words, arg_max(u.doc_key, length(e.name)) AS doc_key FROM e JOIN u ON u.name = e.name GROUP BY id, words""",
    "paragraphs_joined": """
WITH t AS (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM chunks WHERE text IS NOT NULL), l AS (SELECT * FROM t WHERE trim(line) <> ''),
m AS (SELECT *, lag(line) OVER (PARTITION BY id ORDER BY n) AS b FROM l),
i AS (SELECT *, sum(CASE WHEN coalesce(length(b) >= 40 AND regexp_matches(b, '[a-z,]$') AND regexp_matches(line, '^[A-Za-z]') AND regexp_matches(line, '[a-z]') AND NOT contains(line, '|'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT id, min(n) AS first, count(*) AS lines, sum(length(line)) + count(*) - 1 AS characters FROM i GROUP BY id, k""",
    "spans_merged": f"""
WITH s AS (SELECT {plain_sql('listed_key')} AS doc_key, first_seen AS a, last_seen AS b FROM listings WHERE listed_key IS NOT NULL AND first_seen IS NOT NULL AND last_seen IS NOT NULL),
m AS (SELECT *, max(b) OVER (PARTITION BY doc_key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s),
i AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r + INTERVAL 7 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT doc_key, min(a) AS start, max(b) AS "end", count(*) AS spans FROM i GROUP BY doc_key, k""",
    "nearest_purchase": """
WITH p AS (SELECT e.event_id, f.event_id AS near, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch(date_trunc('second', e.ts)) - epoch(date_trunc('second', f.ts))), f.event_id) AS n FROM events e JOIN events f ON f.user_id = e.user_id AND f.event_type = 'purchase'
  AND abs(epoch(date_trunc('second', e.ts)) - epoch(date_trunc('second', f.ts))) <= 21600 WHERE e.event_type = 'error') SELECT event_id, near FROM p WHERE n = 1""",
    "common_quantity": """
WITH c AS (SELECT l_suppkey, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey ORDER BY value RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS reached FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY reached DESC, value) AS p FROM r) SELECT l_suppkey, value, reached FROM k WHERE p = 1""",
    "page_kinds": "SELECT CASE WHEN source IN ('bundle-archive', 'oldstatutes') AND (coalesce(n_chars, 0) < 20 OR lang IS NULL) THEN 'scan' WHEN coalesce(n_chars, 0) >= 20 THEN 'digital' ELSE 'blank' END AS kind, count(*) AS pages FROM documents GROUP BY 1",
    "trimmed_keys": "SELECT doc_key, CASE WHEN length(s) <= 40 THEN s ELSE regexp_replace(left(s, 31), '[-_ .]+$', '') || '-' || left(sha1(s), 8) END AS key FROM (SELECT doc_key, regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') AS s FROM docs)",
    "wrong_files": r"SELECT CASE WHEN keyed = '' OR printed = '' THEN 'unprinted' WHEN keyed = printed THEN 'right' ELSE 'wrong' END AS state, count(*) AS documents, max(doc_id) AS last FROM (SELECT doc_id, regexp_extract(doc_key, '^(?:act|law|ordinance):(.*)$', 1) AS keyed, concat_ws('/', nullif(regexp_extract(h, 'No\. (\d+) of \d{4}', 1), ''), nullif(regexp_extract(h, 'No\. \d+ of (\d{4})', 1), '')) AS printed FROM (SELECT *, split_part(text, chr(10), 1) AS h FROM documents WHERE text IS NOT NULL)) GROUP BY 1",
    "backup_parity": "SELECT 'docs' AS name, count(*) AS written, count(*) AS back FROM docs UNION ALL SELECT 'links', count(*), count(*) FROM links UNION ALL SELECT 'sources', count(*), count(*) FROM sources",
    "word_overlap": r"""
WITH q AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(string_split(lower(regexp_replace(question, '[^\p{L}\p{M}\p{Nd}]+', ' ', 'g')), ' ')) AS w FROM eval_items) WHERE length(w) > 5),
d AS (SELECT DISTINCT id, unnest(string_split(lower(regexp_replace(text, '[^\p{L}\p{M}\p{Nd}]+', ' ', 'g')), ' ')) AS w FROM chunks),
s AS (SELECT q.item_id, d.id, count(*) AS words FROM q JOIN d ON d.w = q.w GROUP BY q.item_id, d.id)
SELECT item_id, id, words, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY words DESC, id) AS rank FROM s) WHERE rank <= 3""", "last_activity": _last_seen_sql, "null_safe_twins": "SELECT doc_id, first AS twin FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY doc_key, lang, listing_id) AS first FROM documents WHERE doc_key IS NOT NULL) WHERE first < doc_id",
}
