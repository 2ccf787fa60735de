"""Queries of the general problems: timestamps (4) and orphan references (7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.instants import MONTHS, listing_norms
from lexloom.operators.orphans import orphans, orphans_by_month
from lexloom.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    norms = listing_norms(table(spark, folder, "listings"), table(spark, folder, "sources"))
    return norms.where("date is not null and date <> norm").select("id", "norm")


def p4_precisions(spark: SparkSession, folder: str) -> DataFrame:
    """How many listings of each source have a date of each precision after normalisation."""
    norms = listing_norms(table(spark, folder, "listings"), table(spark, folder, "sources"))
    shown = F.when(F.col("norm").isNull() | (F.col("norm") == "none"), "none").otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in {4: "year", 7: "month", 10: "day", 20: "time"}.items() for x in kv]), F.length("norm")))
    return norms.groupBy("source", shown.alias("shown")).agg(F.count("*").alias("listings"))


def p7_links(spark: SparkSession, folder: str) -> DataFrame:
    return orphans(table(spark, folder, "links"), table(spark, folder, "docs"), table(spark, folder, "chunks"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_links(spark, folder).select("id", "field", "reason")


def p7_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return orphans_by_month(p7_links(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_precisions": p4_precisions, "p7_found": p7_found, "p7_by_month": p7_by_month}

PLAIN = r"""CASE WHEN regexp_matches(k0, '^gazette:[0-9]+/[0-9]$') THEN replace(k0, '/', '/0') ELSE k0 END"""

P7_ROWS = rf"""
l AS (
  SELECT DISTINCT id, made_at, dst_chunk, lower(trim(dst_label)) AS lab, {PLAIN} AS k
  FROM (SELECT *, regexp_replace(lower(regexp_replace(dst_doc, '\s+', '', 'g')), '(^|[^0-9])0+([0-9])', '\1\2', 'g') AS k0 FROM links)),
r AS (
  SELECT l.id, l.made_at, 'dst_doc' AS field, d.doc_key IS NOT NULL AS held, d.built_at, d.removed_at
  FROM l LEFT JOIN docs d ON d.doc_key = l.k
  UNION ALL
  SELECT l.id, l.made_at, 'dst_chunk', c.id IS NOT NULL, c.built_at, c.removed_at
  FROM l LEFT JOIN chunks c ON c.id = l.dst_chunk WHERE l.dst_chunk IS NOT NULL
  UNION ALL
  SELECT l.id, l.made_at, 'dst_label', c.id IS NOT NULL, c.built_at, c.removed_at
  FROM l JOIN docs d ON d.doc_key = l.k LEFT JOIN chunks c ON c.doc_key = l.k AND lower(trim(c.label)) = l.lab WHERE l.lab IS NOT NULL),
g AS (
  SELECT id, made_at, field, bool_or(held) AS held,
    coalesce(bool_or(built_at <= made_at AND (removed_at IS NULL OR removed_at > made_at)), false) AS alive,
    coalesce(bool_or(built_at > made_at), false) AS later
  FROM r GROUP BY id, made_at, field),
f AS (SELECT id, made_at, field, CASE WHEN NOT held THEN 'missing' WHEN later THEN 'late' ELSE 'deleted' END AS reason FROM g WHERE NOT (held AND alive))
"""

#: The month in words, in SQL: the place of its name in a list of a dozen in each writing.
_NAMES = [name for k in range(4) for names in MONTHS for name in [names[min(k, len(names) - 1)]]] + [names[0][:3] for names in MONTHS]
_MONTH_SQL = "coalesce(try_cast(p[2] AS INT), (list_position([" + ", ".join(f"'{n}'" for n in _NAMES) + "], p[2]) - 1) % 12 + 1)"

#: Norms of the dates of listings in SQL, a writing at a time: n(id, date, norm).
NORMS = rf"""
z AS (SELECT l.*, s.home_zone, s.trust, coalesce(s.date_order, 'dmy') AS date_order, lower(trim(replace(l.date, chr(8205), ''))) AS t FROM listings l LEFT JOIN sources s USING (source)),
w AS (SELECT *, CASE
  WHEN regexp_matches(t, '^\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}([t ]|$)') THEN regexp_replace(t, '^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[t ]+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:\.\d+)?)?)?\s*(z|[+-]\d{{2}}:?\d{{2}})?\s*\[?([a-z_]+/[a-z_]+)?\]?$', '\1|\2|\3|\4|\5|\6||\7|\8')
  WHEN regexp_matches(t, '^\d{{8}}(t\d{{6}}z)?$') THEN regexp_replace(t, '^(\d{{4}})(\d{{2}})(\d{{2}})(?:t(\d{{2}})(\d{{2}})(\d{{2}})(z))?$', '\1|\2|\3|\4|\5|\6||\7|')
  WHEN regexp_matches(t, '^\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d') THEN regexp_replace(t, '^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}})(?: (\d{{1,2}}):(\d{{2}}) ([ap])m)?$', CASE WHEN date_order = 'mdy' THEN '\3|\1|\2|\4|\5||\6||' ELSE '\3|\2|\1|\4|\5||\6||' END)
  WHEN regexp_matches(t, '^([a-z]+, )?\d{{1,2}}(st|nd|rd|th)?[ -][^\d ,-]+,?[ -]\d') THEN regexp_replace(t, '^(?:[a-z]+, )?(\d{{1,2}})(?:st|nd|rd|th)?[ -]([^\d ,-]+),?[ -](\d{{4}}|\d{{2}})(?:,? (\d{{1,2}})[:.](\d{{2}})(?::(\d{{2}}))?)?(?: hrs)?\s*(gmt|[+-]\d{{4}})?$', '\3|\2|\1|\4|\5|\6||\7|')
  WHEN regexp_matches(t, '^[^\d ]+ \d{{1,2}}, \d{{4}}$') THEN regexp_replace(t, '^([^\d ]+) (\d{{1,2}}), (\d{{4}})$', '\3|\1|\2||||||')
  WHEN regexp_matches(t, '^\d{{4}} [^\d ]+ \d{{1,2}}$') THEN regexp_replace(t, '^(\d{{4}}) ([^\d ]+) (\d{{1,2}})$', '\1|\2|\3||||||')
  WHEN regexp_matches(t, '^\d{{4}}-\d{{2}}$') THEN regexp_replace(t, '^(\d{{4}})-(\d{{2}})$', '\1|\2|||||||')
  WHEN regexp_matches(t, '^\d{{1,2}}/\d{{4}}$') THEN regexp_replace(t, '^(\d{{1,2}})/(\d{{4}})$', '\2|\1|||||||')
  WHEN regexp_matches(t, '^(c\. ?|year )?\d{{4}}\.?$') THEN regexp_replace(t, '^(?:c\. ?|year )?(\d{{4}})\.?$', '\1||||||||')
  WHEN regexp_matches(t, '^[^\d ,.]+ \d{{4}}$') THEN regexp_replace(t, '^([^\d ,.]+) (\d{{4}})$', '\2|\1|||||||') END AS r FROM z),
q AS (SELECT *, CASE WHEN r LIKE '%|%|%' THEN string_split(r, '|') END AS p, CASE WHEN regexp_matches(t, '^\d{{9,18}}$') THEN CASE WHEN length(t) > 10 THEN try_cast(t AS BIGINT) // 1000 ELSE try_cast(t AS BIGINT) END END AS counted FROM w),
d AS (SELECT *, CASE WHEN length(p[1]) = 2 THEN CASE WHEN try_cast(p[1] AS INT) >= 48 THEN 1900 + try_cast(p[1] AS INT) WHEN try_cast(p[1] AS INT) <= 26 THEN 2000 + try_cast(p[1] AS INT) END ELSE try_cast(p[1] AS INT) END AS y, CASE WHEN p[2] <> '' THEN {_MONTH_SQL} END AS mo, try_cast(p[3] AS INT) AS dd,
  CASE WHEN p[4] = '' THEN NULL WHEN p[7] = '' THEN try_cast(p[4] AS INT) WHEN try_cast(p[4] AS INT) BETWEEN 1 AND 12 THEN try_cast(p[4] AS INT) % 12 + CASE WHEN p[7] = 'p' THEN 12 ELSE 0 END END AS hh FROM q),
e AS (SELECT *, CASE WHEN p IS NULL OR y IS NULL OR y < 1 OR (p[2] <> '' AND (mo IS NULL OR mo NOT BETWEEN 1 AND 12)) THEN NULL WHEN p[2] = '' THEN 'year' WHEN p[3] = '' THEN 'month'
    WHEN try_cast(printf('%04d-%02d-%02d', y, mo, dd) AS DATE) IS NULL THEN NULL WHEN p[4] = '' THEN 'day' WHEN hh BETWEEN 0 AND 23 AND try_cast(p[5] AS INT) < 60 AND coalesce(try_cast(p[6] AS INT), 0) < 60 THEN 'time' END AS shown FROM d),
m AS (SELECT *, CASE WHEN shown = 'time' THEN try_strptime(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, dd, hh, try_cast(p[5] AS INT), coalesce(try_cast(p[6] AS INT), 0)), '%Y-%m-%d %H:%M:%S') END AS wall,
  CASE WHEN p[8] IN ('z', 'gmt') THEN 0 WHEN p[8] <> '' THEN CASE WHEN p[8] LIKE '-%' THEN -1 ELSE 1 END * (try_cast(p[8][2:3] AS INT) * 3600 + try_cast(right(p[8], 2) AS INT) * 60) END AS off,
  (SELECT any_value(name) FROM pg_timezone_names() WHERE lower(name) = CASE WHEN p[9] <> '' THEN p[9] ELSE lower(home_zone) END) AS zone FROM e),
i AS (SELECT *, CASE WHEN counted IS NOT NULL THEN counted WHEN wall IS NULL THEN NULL WHEN off IS NOT NULL THEN try_cast(epoch(wall) AS BIGINT) - off ELSE try_cast(epoch(timezone(zone, wall)) AS BIGINT) END AS sec0 FROM m),
j AS (SELECT *, CASE WHEN counted IS NULL AND off IS NULL AND sec0 IS NOT NULL THEN CASE WHEN timezone(zone, to_timestamp(sec0 - 3600)) = wall THEN sec0 - 3600 WHEN timezone(zone, to_timestamp(sec0 - 1800)) = wall THEN sec0 - 1800 ELSE sec0 END ELSE sec0 END AS sec FROM i),
n AS (SELECT *, CASE WHEN date IS NULL THEN NULL WHEN counted IS NOT NULL THEN left(strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%SZ'), CASE lower(date_precision) WHEN 'year' THEN 4 WHEN 'day' THEN 10 ELSE 20 END)
    WHEN shown IS NULL THEN 'none' WHEN shown = 'year' OR date_precision = 'year' THEN printf('%04d', y) WHEN shown = 'month' THEN printf('%04d-%02d', y, mo) WHEN shown = 'day' OR date_precision = 'day' THEN printf('%04d-%02d-%02d', y, mo, dd)
    ELSE strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS norm FROM j)
"""

ORACLE: dict[str, str] = {
    "p4_found": f"WITH {NORMS} SELECT id, norm FROM n WHERE date <> norm",
    "p4_precisions": f"WITH {NORMS} SELECT source, CASE WHEN norm IS NULL OR norm = 'none' THEN 'none' ELSE CASE length(norm) WHEN 4 THEN 'year' WHEN 7 THEN 'month' WHEN 10 THEN 'day' ELSE 'time' END END AS shown, count(*) AS listings FROM n GROUP BY 1, 2",
    "p7_found": f"WITH {P7_ROWS} SELECT id, field, reason FROM f",
    "p7_by_month": f"WITH {P7_ROWS} SELECT strftime(made_at, '%Y-%m') AS month, field, reason, count(*) AS orphans FROM f GROUP BY ALL",
}
