"""Queries of link resolution and of the citation graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.keys import plain_label
from lexloom.operators import graph as g
from lexloom.operators import links as r
from lexloom.operators.best import first_rows
from lexloom.plans.shared import LINKS, both, plain_links
from lexloom.tables import table

MOMENT = "2024-06-01 00:00:00"


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Every link that isn't an equivalence, as a mention with the labels that it names."""
    label = F.when(F.col("dst_label").isNotNull(), F.array(plain_label(F.col("dst_label")))).otherwise(F.array().cast("array<string>"))
    return plain_links(spark, folder).where("kind <> 'same_as'").select("id", "kind", "src_doc", "dst_doc", label.alias("labels"))


def _twins(spark: SparkSession, folder: str) -> DataFrame:
    return r.twins(plain_links(spark, folder).where("kind = 'same_as'"), "src_doc", "dst_doc")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").withColumn("label", plain_label(F.col("label")))


def alias_closure(spark: SparkSession, folder: str) -> DataFrame:
    return _twins(spark, folder)


def resolve_links(spark: SparkSession, folder: str) -> DataFrame:
    return r.provision_links(r.asked(_mentions(spark, folder)), _twins(spark, folder), _labelled(spark, folder))


def resolve_whole(spark: SparkSession, folder: str) -> DataFrame:
    return r.whole_links(r.asked(_mentions(spark, folder)), _twins(spark, folder), table(spark, folder, "docs"))


def resolve_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Repeals of a whole Part, link by link: the Part named is the scope in the address of its units; a link that names none has no row."""
    named = plain_links(spark, folder).where("kind = 'repeals' and part_named is not null").select("id", "kind", "src_doc", "dst_doc", F.array(F.trim("part_named")).alias("labels"))
    units = table(spark, folder, "chunks").where("kind = 'unit'").withColumn("scope", F.element_at(F.split("address", "/"), -3))
    return r.part_links(named, _twins(spark, folder), units)


def mention_status(spark: SparkSession, folder: str) -> DataFrame:
    mentions, pairs = _mentions(spark, folder), _twins(spark, folder)
    rows = r.asked(mentions)
    docs = table(spark, folder, "docs")
    inserted = r.asked(mentions.where("kind = 'inserts'")).where("label is not null").select(F.col("dst_doc").alias("doc"), "label")
    out = r.statuses(mentions, pairs, docs, r.provision_links(rows, pairs, _labelled(spark, folder)), r.whole_links(rows, pairs, docs), inserted)
    return out.select("id", "status", F.array_join("unresolved", ",").alias("unresolved"))


def section_heads(spark: SparkSession, folder: str) -> DataFrame:
    return g.heads(table(spark, folder, "chunks"))


def section_runs(spark: SparkSession, folder: str) -> DataFrame:
    return g.section_runs(table(spark, folder, "chunks"), most=2)


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    return g.timeline(plain_links(spark, folder))


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return g.changes_into(plain_links(spark, folder), g.heads(table(spark, folder, "chunks")))


def changes_into(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder).select("chunk", "id", "kind")


def as_of_section(spark: SparkSession, folder: str) -> DataFrame:
    return g.as_of(_changes(spark, folder), F.lit(MOMENT).cast("timestamp"))


def change_status(spark: SparkSession, folder: str) -> DataFrame:
    return g.change_status(_changes(spark, folder))


def cited_by_total(spark: SparkSession, folder: str) -> DataFrame:
    return g.cited_by(plain_links(spark, folder), F.col("src_doc").startswith("ca:") | F.col("src_doc").startswith("sc:"))


def links_out(spark: SparkSession, folder: str) -> DataFrame:
    """The newest five links into each document from others."""
    into = plain_links(spark, folder).where("src_doc <> dst_doc")
    return first_rows(into, ["dst_doc"], [F.desc_nulls_last("made_at"), F.desc("id")], 5).select("dst_doc", "rank", "id")


def links_grouped(spark: SparkSession, folder: str) -> DataFrame:
    """How often a law is linked by each other and in what way, with at most ten parts."""
    grouped = plain_links(spark, folder).groupBy("dst_doc", "src_doc", "kind").agg(F.count("*").alias("links"), F.array_sort(F.collect_set("dst_label")).alias("parts"))
    return grouped.select("dst_doc", "src_doc", "kind", "links", F.array_join(F.slice("parts", 1, 10), ",").alias("parts"))


def first_amended(spark: SparkSession, folder: str) -> DataFrame:
    """For each amending document the first other law that it amends, by link id."""
    amends = plain_links(spark, folder).where("kind = 'amends_act' and src_doc <> dst_doc")
    return amends.groupBy("src_doc").agg(F.min_by("dst_doc", "id").alias("law"))


def later_gazettes(spark: SparkSession, folder: str) -> DataFrame:
    """Gazettes made under each law, each kind and gazette once, with the first time."""
    under = plain_links(spark, folder).where("src_doc like 'gazette:%' and kind in ('made_under', 'amends', 'repeals')")
    return under.groupBy("dst_doc", "kind", "src_doc").agg(F.min("made_at").alias("first_made"))


HEADS_SQL = """h AS (SELECT id, doc_key, seq, crumb, last_value(CASE WHEN coalesce(crumb NOT LIKE '% (cont.)', true) THEN id END IGNORE NULLS)
  OVER (PARTITION BY doc_key, CASE WHEN crumb LIKE '% (cont.)' THEN left(crumb, length(crumb) - 8) ELSE crumb END ORDER BY seq ROWS UNBOUNDED PRECEDING) AS head FROM chunks)"""
CHANGES_SQL = f"""WITH {LINKS}, {HEADS_SQL},
w AS (SELECT id AS chunk, id AS dst_chunk FROM h UNION SELECT id, coalesce(head, id) FROM h),
c AS (SELECT w.chunk, l.id, l.kind, l.src_chunk, l.src_doc, l.made_at FROM l JOIN w USING (dst_chunk) WHERE l.kind IN ('replaces', 'repeals', 'inserts', 'amends'))"""
RESOLVE_SQL = f"""WITH {LINKS},
t AS (SELECT src_doc AS doc, dst_doc AS twin FROM l WHERE kind = 'same_as' AND src_doc <> dst_doc UNION SELECT dst_doc, src_doc FROM l WHERE kind = 'same_as' AND src_doc <> dst_doc),
m AS (SELECT id, kind, dst_doc, lower(trim(dst_label)) AS label FROM l WHERE kind <> 'same_as'),
k AS (SELECT DISTINCT id, dst_doc, label, dst_doc AS doc, 0 AS pref FROM m UNION SELECT m.id, m.dst_doc, m.label, t.twin, 1 FROM m JOIN t ON t.doc = m.dst_doc),
p AS (SELECT k.id, k.label, c.id AS dst_chunk, k.doc <> k.dst_doc AS via_alias,
  row_number() OVER (PARTITION BY k.id, k.label ORDER BY k.pref, c.seq, c.id) AS n FROM k JOIN chunks c ON c.doc_key = k.doc AND lower(trim(c.label)) = k.label WHERE k.label IS NOT NULL),
w AS (SELECT k.id, k.doc AS held_doc, row_number() OVER (PARTITION BY k.id ORDER BY k.pref, k.doc) AS n FROM k JOIN docs d ON d.doc_key = k.doc WHERE k.label IS NULL)"""

_coverage, _coverage_sql = both("""
SELECT (SELECT count(*) FROM {docs}) AS docs, (SELECT count(*) FROM {docs} WHERE removed_at IS NULL) AS docs_now, (SELECT count(*) FROM {chunks}) AS chunks,
  (SELECT count(DISTINCT doc_key) FROM {chunks}) AS docs_with_chunks, (SELECT count(*) FROM {links}) AS links, (SELECT count(DISTINCT source) FROM {listings}) AS sources
""")
_doc_chunks, _doc_chunks_sql = both("""
SELECT d.doc_key, d.title, count(c.id) AS chunks, sum(length(c.text)) AS characters, min(c.seq) AS first_seq, max(c.seq) AS last_seq
FROM {docs} d LEFT JOIN {chunks} c ON c.doc_key = d.doc_key GROUP BY d.doc_key, d.title
""")
_link_kinds, _link_kinds_sql = both("""
SELECT lower(trim(kind)) AS kind, count(*) AS links, count(DISTINCT src_chunk) AS chunks, sum(CASE WHEN via_alias THEN 1 ELSE 0 END) AS via_alias, min(made_at) AS first_made
FROM {links} GROUP BY lower(trim(kind))
""")
_doc_info, _doc_info_sql = both("""
SELECT d.doc_key, d.kind, d.doc_year, x.doc_id, x.lang, l.source, l.source_url FROM {docs} d
LEFT JOIN (SELECT doc_key, max(doc_id) AS doc_id, max(lang) AS lang, max(listing_id) AS listing_id FROM {documents} GROUP BY doc_key) x ON x.doc_key = d.doc_key
LEFT JOIN {listings} l ON l.id = x.listing_id
""")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "alias_closure": alias_closure,
    "resolve_links": resolve_links,
    "resolve_whole": resolve_whole,
    "resolve_parts": resolve_parts,
    "mention_status": mention_status,
    "section_heads": section_heads,
    "section_runs": section_runs,
    "timeline": timeline,
    "changes_into": changes_into,
    "as_of_section": as_of_section,
    "change_status": change_status,
    "cited_by_total": cited_by_total,
    "links_newest": links_out,
    "links_grouped": links_grouped,
    "first_amended": first_amended,
    "later_gazettes": later_gazettes,
    "coverage_counts": _coverage,
    "doc_with_chunks": _doc_chunks,
    "link_kinds": _link_kinds,
    "doc_info": _doc_info,
}

ORACLE: dict[str, str] = {
    "alias_closure": f"{RESOLVE_SQL} SELECT doc, twin FROM t",
    "resolve_links": f"{RESOLVE_SQL} SELECT id, label, dst_chunk, via_alias FROM p WHERE n = 1",
    "resolve_whole": f"{RESOLVE_SQL} SELECT id, held_doc FROM w WHERE n = 1",
    "resolve_parts": f"""{RESOLVE_SQL},
u AS (SELECT *, string_split(address, '/') AS a FROM chunks WHERE kind = 'unit' AND label IS NOT NULL),
x AS (SELECT k.id, k.pref, k.doc, u.a[len(u.a) - 2] AS part, u.label, u.seq, u.id AS dst_chunk FROM (SELECT DISTINCT k.id, k.pref, k.doc, trim(n.part_named) AS named FROM k JOIN m USING (id) JOIN links n USING (id) WHERE m.kind = 'repeals') k
  JOIN u ON u.doc_key = k.doc AND u.a[len(u.a) - 2] = k.named),
f AS (SELECT id, part, doc FROM (SELECT *, row_number() OVER (PARTITION BY id, part ORDER BY pref, doc) AS n FROM (SELECT DISTINCT id, part, pref, doc FROM x)) WHERE n = 1),
y AS (SELECT x.id, x.part, x.label, x.dst_chunk, row_number() OVER (PARTITION BY x.id, x.part, x.label ORDER BY x.seq, x.dst_chunk) AS n FROM x JOIN f USING (id, part, doc))
SELECT id, part, label, dst_chunk FROM y WHERE n = 1""",
    "mention_status": f"""{RESOLVE_SQL},
i AS (SELECT DISTINCT dst_doc, label FROM m WHERE kind = 'inserts' AND label IS NOT NULL),
held AS (SELECT DISTINCT k.id FROM k JOIN docs d ON d.doc_key = k.doc),
s AS (SELECT m.id, m.dst_doc, m.label, CASE WHEN m.label IS NULL THEN m.id IN (SELECT id FROM w) ELSE m.id IN (SELECT id FROM p) END AS ok,
  m.id IN (SELECT id FROM held) AS held, i.label IS NOT NULL AS put_in FROM m LEFT JOIN i ON i.dst_doc = m.dst_doc AND i.label = m.label),
g AS (SELECT id, any_value(dst_doc) AS dst_doc, bool_and(ok) AS all_ok, bool_or(ok) AS any_ok, bool_or(held) AS held, bool_and(ok OR put_in) AS accounted, string_agg(DISTINCT CASE WHEN NOT ok THEN label END, ',' ORDER BY CASE WHEN NOT ok THEN label END) AS open FROM s GROUP BY id)
SELECT id, CASE WHEN dst_doc IS NULL THEN 'unidentified' WHEN all_ok THEN 'resolved' WHEN NOT held THEN 'not_held' WHEN any_ok THEN 'partial' WHEN accounted THEN 'inserted' ELSE 'label_not_found' END AS status,
  CASE WHEN NOT all_ok THEN open END AS unresolved FROM g""",
    "section_heads": f"WITH {HEADS_SQL} SELECT id, head FROM h",
    "section_runs": """
WITH b AS (SELECT id, doc_key, seq, crumb LIKE '% (cont.)' AS cont, CASE WHEN crumb LIKE '% (cont.)' THEN left(crumb, length(crumb) - 8) ELSE crumb END AS base FROM chunks WHERE crumb IS NOT NULL),
s AS (SELECT *, CASE WHEN NOT cont OR seq - lag(seq) OVER (PARTITION BY doc_key, base ORDER BY seq) <> 1 THEN 1 ELSE 0 END AS start FROM b),
r AS (SELECT *, sum(start) OVER (PARTITION BY doc_key, base ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT arg_min(id, seq) AS head, least(count(*), 2) AS pieces, count(*) > 2 AS more FROM r GROUP BY doc_key, base, run HAVING NOT arg_min(cont, seq)
""",
    "timeline": f"WITH {LINKS} SELECT dst_doc, src_doc, min(made_at) AS first_made FROM l WHERE kind IN ('replaces', 'repeals', 'inserts', 'amends') AND src_doc <> dst_doc GROUP BY ALL",
    "changes_into": f"{CHANGES_SQL} SELECT chunk, id, kind FROM c",
    "as_of_section": f"""{CHANGES_SQL} SELECT chunk, coalesce(src_chunk, src_doc) AS src, arg_min(kind, CASE kind WHEN 'replaces' THEN 0 WHEN 'repeals' THEN 1 WHEN 'inserts' THEN 2 ELSE 3 END) AS kind,
  min(made_at) AS made_at, coalesce(min(made_at) <= TIMESTAMP '{MOMENT}', true) AS applies FROM c GROUP BY chunk, coalesce(src_chunk, src_doc)""",
    "change_status": f"{CHANGES_SQL} SELECT chunk, count(DISTINCT coalesce(src_chunk, src_doc)) AS sections, max(made_at) AS last_change, max(CASE WHEN kind = 'repeals' THEN made_at END) AS last_repeal FROM c GROUP BY chunk",
    "cited_by_total": f"""WITH {LINKS}, p AS (SELECT dst_chunk, src_doc, arg_min_null(src_chunk, id) AS passage, count(*) AS passages FROM l
  WHERE kind = 'cites' AND dst_chunk IS NOT NULL AND (src_doc LIKE 'ca:%' OR src_doc LIKE 'sc:%') GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY dst_chunk) AS total FROM p""",
    "links_newest": f"WITH {LINKS}, n AS (SELECT dst_doc, id, row_number() OVER (PARTITION BY dst_doc ORDER BY made_at DESC NULLS LAST, id DESC) AS rank FROM l WHERE src_doc <> dst_doc) SELECT dst_doc, rank, id FROM n WHERE rank <= 5",
    "links_grouped": f"""WITH {LINKS} SELECT dst_doc, src_doc, kind, count(*) AS links, coalesce(array_to_string(list_sort(list(DISTINCT dst_label) FILTER (WHERE dst_label IS NOT NULL))[1:10], ','), '') AS parts FROM l GROUP BY dst_doc, src_doc, kind""",
    "first_amended": f"WITH {LINKS} SELECT src_doc, arg_min(dst_doc, id) AS law FROM l WHERE kind = 'amends_act' AND src_doc <> dst_doc GROUP BY src_doc",
    "later_gazettes": f"WITH {LINKS} SELECT dst_doc, kind, src_doc, min(made_at) AS first_made FROM l WHERE src_doc LIKE 'gazette:%' AND kind IN ('made_under', 'amends', 'repeals') GROUP BY ALL",
    "coverage_counts": _coverage_sql,
    "doc_with_chunks": _doc_chunks_sql,
    "link_kinds": _link_kinds_sql,
    "doc_info": _doc_info_sql,
}
