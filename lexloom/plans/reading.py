"""Queries of pages, labels, reads of the corpus and checks. A chunk stands for a page of its document, its lines for blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import labels as lb
from lexloom.functions import text as t
from lexloom.operators import choice, pages, quality
from lexloom.operators import graph as g
from lexloom.plans.shared import LINKS, plain_links
from lexloom.tables import path_of, shared_folder, table

LAST_PAGE = 40


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return pages.blocks_of(table(spark, folder, "chunks").select("id", "doc_key", "seq", "text"), "doc_key", "id", "text")


def running_titles(spark: SparkSession, folder: str) -> DataFrame:
    return pages.running_titles(_blocks(spark, folder), "doc_key", "id")


def page_gutters(spark: SparkSession, folder: str) -> DataFrame:
    return pages.gutters(pages.words_of(_blocks(spark, folder), ["id"]), ["id"])


def spread_halves(spark: SparkSession, folder: str) -> DataFrame:
    return pages.spread_halves(pages.words_of(_blocks(spark, folder), ["id"]), ["id"])


def lines_from_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of orders as cells: their quantity is the height, their number the place from the left."""
    return pages.lines_from_cells(table(spark, folder, "lineitem"), "l_orderkey", "l_quantity", "l_linenumber", "l_linenumber", 3.0)


def margin_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Short lines as margin notes, each with the nearest long one."""
    blocks = _blocks(spark, folder)
    short = F.length("text") < 30
    return pages.notes_to_bodies(blocks.where(short), blocks.where(~short), "id", 3)


def _document_lines(spark: SparkSession, folder: str) -> DataFrame:
    return pages.blocks_of(table(spark, folder, "documents").select("doc_id", F.lit(0).alias("p"), "text"), "doc_id", "p", "text")


def table_cells(spark: SparkSession, folder: str) -> DataFrame:
    return pages.table_cells(_document_lines(spark, folder), ["doc_id"])


def tables_as_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.rows_to_text(table_cells(spark, folder), ["doc_id"])


def law_rows_html(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks set as rows of a law in HTML, a narrow cell for the label, and read again as (note, text)."""
    escaped = F.replace(F.replace("crumb", F.lit("&"), F.lit("&amp;")), F.lit("\n"), F.lit(" "))
    row = F.concat(F.lit('<tr><td width="'), F.when(F.col("label").isNull(), "400").otherwise("90"), F.lit('">'), F.coalesce("label", F.lit("")), F.lit("</td><td><b>"), escaped, F.lit("</b></td></tr>"))
    html = table(spark, folder, "chunks").where("crumb is not null").groupBy("doc_key", "kind").agg(F.concat_ws("\n", F.array_sort(F.collect_list(row))).alias("html"))
    return html.select("doc_key", F.explode(pages.html_rows(F.col("html"))).alias("r")).select("doc_key", "r.note", F.trim("r.text").alias("text"))


def bundle_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of a bundle that come without pages, their lines set on pages of twenty."""
    rows = table(spark, folder, "documents").where("source = 'bundle-archive'").select("doc_id", F.lit(0).alias("p"), "text")
    set_ = pages.paged(pages.blocks_of(rows, "doc_id", "p", "text"), "doc_id", ["n"], 20)
    return set_.groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.max_by("text", "place").alias("last"))


def crawled_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Listings landed as pages of HTML with data attributes, and read back as rows: titles and dates as they were."""
    value = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    row = F.concat(F.lit('<tr data-id="'), F.col("id").cast("string"), F.lit('" data-title="'), value("title"), F.lit('" data-date="'), value("date"), F.lit('"><td>x</td></tr>'))
    landed = f"{shared_folder(spark)}/crawled-{folder.rstrip('/').rpartition('/')[2]}"
    # A page is bounded: so many rows of one source.
    rows = table(spark, folder, "listings").select("source", F.floor(F.col("id") / 500).alias("page"), row.alias("row"))
    html = rows.groupBy("source", "page").agg(F.concat(F.lit("<html><table>"), F.concat_ws("\n", F.collect_list("row")), F.lit("</table></html>")).alias("html"))
    html.write.mode("overwrite").parquet(landed)
    path_of(spark, landed)[1].deleteOnExit(path_of(spark, landed)[0])
    read = spark.read.parquet(landed).select("source", F.explode(pages.data_rows(F.col("html"), ["id", "title", "date"])).alias("r"))
    return read.select("source", F.col("r.id").cast("long").alias("id"), "r.title", "r.date")


def extracted_files(spark: SparkSession, folder: str) -> DataFrame:
    """What reads each document's file, by its first characters, and whether it has too few letters and must be read from images."""
    rows = table(spark, folder, "documents").withColumn("kind", choice.sniffed(F.col("text")))
    text = F.when(F.col("kind") == "html", t.html_to_text(F.col("text"))).otherwise(F.col("text"))
    return rows.select("doc_id", F.coalesce("kind", F.lit("none")).alias("by"), (F.coalesce(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(0)) < 40).alias("needs_ocr"))


def without_masthead(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of gazettes, and those that are left without the title above and the running titles."""
    own = table(spark, folder, "documents").where("doc_key like 'gazette:%'").select("doc_id", "title", "text")
    lines = pages.blocks_of(own, "doc_id", "title", "text")
    head = (pages.bare(F.col("text")) == pages.bare(F.col("title"))) | F.col("text").rlike(r"^\s*[0-9]{1,4}\s*$")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(F.when(~F.coalesce(head, F.lit(False)), 1)).alias("kept"))


def long_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", lb.long_title(F.col("text")).alias("long_title")).where("long_title is not null")


def document_years(spark: SparkSession, folder: str) -> DataFrame:
    year = F.regexp_extract("doc_key", r"[/-](\d{4})$", 1).try_cast("int")
    return table(spark, folder, "docs").select("doc_key", F.coalesce(year, F.col("doc_year")).alias("year"), F.coalesce(year != F.col("doc_year"), F.lit(False)).alias("differs"))


def label_kinds(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("dst_label")
    first = F.regexp_extract(label, r"(?i)^\s*(\w+)\s+schedule", 1)
    return table(spark, folder, "links").select("id", lb.provision_kind(label).alias("kind"), lb.schedule_name(label).alias("schedule"), lb.ordinal(first).alias("number"))


def shown_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "docs").select("doc_key", lb.shown_key(F.col("doc_key")).alias("shown"), lb.title_key(F.col("title")).alias("title_key"))


def page_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges made of lines and pages of listings, read within a last page."""
    p = F.get_json_object("listing", "$.pages").cast("int")
    asked = F.when(F.col("id") % 3 == 0, p.cast("string")).when(F.col("id") % 3 == 1, F.concat(p.cast("string"), F.lit("-"), (p + 5).cast("string"))).otherwise(F.concat((p + 2).cast("string"), F.lit("–"), p.cast("string")))
    read = lb.page_range(asked, LAST_PAGE)
    return table(spark, folder, "listings").select("id", read["first"].alias("first"), read["last"].alias("last"))


def text_signs(spark: SparkSession, folder: str) -> DataFrame:
    """What a chunk's signs tell: letters of fonts without Unicode, quotations left open, its length as one line, its rough tokens."""
    text = F.col("text")
    return table(spark, folder, "chunks").select("id", lb.odd_share(text).alias("odd"), lb.open_quotes(text).alias("open"), F.length(lb.joined_lines(text)).alias("characters"), t.rough_tokens(text).cast("int").alias("tokens"))


def near_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of sections with the kind of law named within twelve characters behind them."""
    pairs = lb.near_pairs(F.col("text"), r"[Ss]ection [0-9]+[A-Z]?", r"Act|Ordinance|Schedule|of the", 12)
    return table(spark, folder, "chunks").select("id", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def median_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The median length of the lines of each kind of chunk."""
    rows = table(spark, folder, "chunks").select("id", F.coalesce("kind", F.lit("none")).alias("kind"), "text")
    return pages.blocks_of(rows, "kind", "id", "text").groupBy("kind").agg(F.median(F.length("text")).alias("median"), F.count("*").alias("lines"))


def chunks_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that links of repeal point at, each once."""
    asked = plain_links(spark, folder).where("kind = 'repeals' and dst_chunk is not null").select(F.col("dst_chunk").alias("id"))
    return table(spark, folder, "chunks").join(asked, "id", "left_semi").select("id", "doc_key", "seq", "label", F.length("text").alias("characters"))


def links_of(spark: SparkSession, folder: str) -> DataFrame:
    """The newest links of some kinds out of and into each act, self-links aside, three a direction."""
    out = g.links_of(plain_links(spark, folder), "out", ["amends", "repeals"], 3)
    into = g.links_of(plain_links(spark, folder), "in", ["amends", "repeals"], 3)
    return out.withColumn("way", F.lit("out")).unionByName(into.withColumn("way", F.lit("in"))).where("doc like 'act:%'")


def history(spark: SparkSession, folder: str) -> DataFrame:
    """What a reader sees of a document's history: how many laws change it, the first and last time, the law that it changes first."""
    links = plain_links(spark, folder)
    return g.history(table(spark, folder, "docs").select("doc_key"), links)


def status_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Each changed chunk's state in words."""
    changes = g.changes_into(plain_links(spark, folder), g.heads(table(spark, folder, "chunks")))
    return g.status_sentence(g.change_status(changes)).select("chunk", "status")


def whole_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each section of two pieces or more, its pieces in order, eight at most."""
    chunks = table(spark, folder, "chunks").where("text is not null")
    out = g.whole_sections(chunks, 8).where("pieces > 1")
    return out.select("head", "pieces", F.length("text").alias("characters"), F.md5("text").alias("hash"))


def embedding_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What is sent to an embedding service for each chunk: title, path and text, cut at its bound, with its hash; short ones aren't."""
    docs = table(spark, folder, "docs").select("doc_key", "title")
    text = F.concat(F.concat_ws(" › ", "title", "crumb"), F.lit("\n\n"), "text")
    rows = table(spark, folder, "chunks").where(F.length("text") >= 40).join(docs, "doc_key").select("id", F.left(text, F.lit(65000)).alias("sent"))
    return rows.select("id", F.length("sent").alias("characters"), F.sha1("sent").alias("hash"))


def builder_checks(spark: SparkSession, folder: str) -> DataFrame:
    return quality.builder_checks(table(spark, folder, "chunks"), table(spark, folder, "docs")).groupBy("check", "severity").agg(F.count("*").alias("issues"), F.count_distinct("doc_key").alias("documents"))


def gate_with_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Labels lost between two builds, without those that are accepted: those of documents that are removed."""
    chunks = table(spark, folder, "chunks")
    at = lambda day: chunks.where((F.col("built_at") <= F.lit(day).cast("timestamp")) & (F.col("removed_at").isNull() | (F.col("removed_at") > F.lit(day).cast("timestamp"))))
    accepted = table(spark, folder, "docs").where("removed_at is not null").select("doc_key", F.lit(None).cast("string").alias("label"), F.lit("removed").alias("reason"))
    return quality.gate(quality.labels_changed(at("2024-01-01"), at("2025-06-01")), accepted)


def gold_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Links with a chunk against those with a label as gold, by kind, with the precision that each must reach."""
    links = plain_links(spark, folder)
    found = links.where("dst_chunk is not null").select("kind", "src_doc", "dst_doc", F.lower(F.trim("dst_label")).alias("label"))
    gold = links.where("dst_label is not null and dst_chunk is not null and dst_doc is not null").select("kind", "src_doc", "dst_doc", F.lower(F.trim("dst_label")).alias("label"))
    return quality.against_bars(quality.gold_scores(found, gold, ["src_doc", "dst_doc", "label"], "kind"), {"cites": 0.95, "amends": 0.9}, 0.9)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    running_titles, page_gutters, spread_halves, lines_from_cells, margin_notes, table_cells, tables_as_text, law_rows_html, bundle_pages, crawled_rows, extracted_files, without_masthead, long_titles, document_years, label_kinds, shown_titles, page_ranges,
    text_signs, near_citations, median_lines, chunks_by_id, links_of, history, status_sentences, whole_sections, embedding_rows, builder_checks, gate_with_overrides, gold_bars)}

_LINES = r"bl AS (SELECT id, doc_key, kind, n - 1 AS n, line AS text FROM (SELECT id, doc_key, kind, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM chunks) WHERE trim(line) <> '')"
_WORDS = _LINES + r""",
ws AS (SELECT id, n, string_split(text, ' ') AS p FROM bl),
wp AS (SELECT id, n, unnest(list_transform(range(1, len(p) + 1), lambda i: {'word': p[i], 'l': coalesce(list_sum(list_transform(p[1:i - 1], lambda v: length(v) + 1)), 0)})) AS w FROM ws),
wd AS (SELECT id, n, w.word AS word, CAST(w.l AS BIGINT) AS l, CAST(w.l AS BIGINT) + length(w.word) AS r FROM wp WHERE w.word <> '')"""
_DLINES = r"dl AS (SELECT doc_id, title, doc_key, n - 1 AS n, line AS text FROM (SELECT doc_id, title, doc_key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE trim(line) <> '')"
_CELLS = _DLINES + r""",
tc AS (SELECT doc_id, n, unnest(c) AS cell, generate_subscripts(c, 1) - 1 AS "column" FROM (SELECT doc_id, n, list_transform(string_split(regexp_replace(text, '^\s*\||\|\s*$', '', 'g'), '|'), lambda x: trim(x)) AS c FROM dl WHERE contains(text, '|')))"""
_BARE = lambda c: rf"regexp_replace(lower({c}), '[^\p{{L}}]', '', 'g')"
_HEADS = "h AS (SELECT id, doc_key, seq, crumb, last_value(CASE WHEN coalesce(crumb NOT LIKE '% (cont.)', true) THEN id END IGNORE NULLS) OVER (PARTITION BY doc_key, CASE WHEN crumb LIKE '% (cont.)' THEN left(crumb, length(crumb) - 8) ELSE crumb END ORDER BY seq ROWS UNBOUNDED PRECEDING) AS head FROM chunks)"
_BUILDS = """o AS (SELECT * FROM chunks WHERE built_at <= TIMESTAMP '2024-01-01' AND (removed_at IS NULL OR removed_at > TIMESTAMP '2024-01-01')),
n AS (SELECT * FROM chunks WHERE built_at <= TIMESTAMP '2025-06-01' AND (removed_at IS NULL OR removed_at > TIMESTAMP '2025-06-01'))"""

ORACLE: dict[str, str] = {
    "running_titles": f"WITH {_LINES}, b AS (SELECT DISTINCT doc_key, id, {_BARE('text')} AS title FROM bl WHERE length({_BARE('text')}) > 3), a AS (SELECT doc_key, count(DISTINCT id) AS n FROM bl GROUP BY doc_key) SELECT b.doc_key, title, count(*) AS pages FROM b JOIN a USING (doc_key) GROUP BY b.doc_key, title, a.n HAVING count(*) >= 2 AND count(*) >= 0.25 * a.n",
    "page_gutters": f"""WITH {_WORDS}, s AS (SELECT id, max(r) AS width FROM wd GROUP BY id HAVING max(r) >= 8),
p AS (SELECT id, width, unnest(range(CAST(ceil(width / 16.0) AS BIGINT), CAST(floor(width * 3 / 16.0) AS BIGINT) + 1)) * 4 AS g FROM s),
x AS (SELECT p.id, p.g, any_value(p.width) AS width, count(wd.id) AS c FROM p LEFT JOIN wd ON wd.id = p.id AND wd.l < p.g AND wd.r > p.g GROUP BY p.id, p.g)
SELECT id, CAST(arg_min(g, c * 10000000000 + abs(2 * g - width) * 100000 + g) AS INT) AS gutter, min(c) AS crossed FROM x GROUP BY id""",
    "spread_halves": f"WITH {_WORDS}, m AS (SELECT *, max(r) OVER (PARTITION BY id) AS width FROM wd) SELECT id, CASE WHEN (l + r) / 2.0 < width / 2.0 THEN 'left' ELSE 'right' END AS half, count(*) AS words FROM m GROUP BY 1, 2",
    "lines_from_cells": """
WITH f AS (SELECT l_orderkey, l_quantity, l_linenumber, CASE WHEN l_quantity - lag(l_quantity) OVER w > 3 OR lag(l_quantity) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber)),
n AS (SELECT *, CAST(sum(f) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber ROWS UNBOUNDED PRECEDING) AS INT) AS line FROM f)
SELECT l_orderkey, line, min(l_quantity) AS top, string_agg(CAST(l_linenumber AS VARCHAR), ' ' ORDER BY l_linenumber) AS text FROM n GROUP BY l_orderkey, line""",
    "margin_notes": f"WITH {_LINES} SELECT a.id, a.n AS note, arg_min(b.n, abs(a.n - b.n) * 100000 + b.n) AS body FROM bl a JOIN bl b ON a.id = b.id AND b.n BETWEEN a.n - 3 AND a.n + 3 WHERE length(a.text) < 30 AND length(b.text) >= 30 GROUP BY a.id, a.n",
    "table_cells": f'WITH {_CELLS} SELECT doc_id, n, "column", cell FROM tc',
    "tables_as_text": f"""WITH {_CELLS}, r AS (SELECT doc_id, n, string_agg(cell, ' | ' ORDER BY "column") AS row FROM tc WHERE cell <> '' GROUP BY doc_id, n) SELECT doc_id, string_agg(row, chr(10) ORDER BY n) AS text FROM r GROUP BY doc_id""",
    "law_rows_html": "SELECT doc_key, label AS note, trim(replace(crumb, chr(10), ' ')) AS text FROM chunks WHERE crumb IS NOT NULL",
    "bundle_pages": f"WITH {_DLINES}, p AS (SELECT dl.doc_id, dl.text, row_number() OVER (PARTITION BY dl.doc_id ORDER BY n) - 1 AS k FROM dl JOIN documents d ON d.doc_id = dl.doc_id AND d.source = 'bundle-archive') SELECT doc_id, CAST(k // 20 + 1 AS INT) AS page, count(*) AS lines, arg_max(text, k) AS last FROM p GROUP BY 1, 2",
    "crawled_rows": "SELECT source, id, nullif(title, '') AS title, nullif(date, '') AS date FROM listings",
    "extracted_files": r"SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'none' WHEN starts_with(ltrim(text[1:64]), '%PDF') THEN 'pdf' WHEN starts_with(ltrim(text[1:64]), '<') THEN 'html' ELSE 'other' END AS by, coalesce(len(regexp_extract_all(text, '\p{L}')), 0) < 40 AS needs_ocr FROM documents",
    "without_masthead": rf"WITH {_DLINES} SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE NOT coalesce({_BARE('text')} = {_BARE('title')} OR regexp_matches(text, '^\s*[0-9]{{1,4}}\s*$'), false)) AS kept FROM dl WHERE doc_key LIKE 'gazette:%' GROUP BY doc_id",
    "long_titles": r"WITH s AS (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:40], chr(10)) AS t FROM documents) SELECT doc_id, nullif(regexp_extract(t, '(?m)^(An (?:Act|Ordinance|Law|Order) to [^\n]*|Regulations to [^\n]*)', 1), '') AS long_title FROM s WHERE regexp_extract(t, '(?m)^(An (?:Act|Ordinance|Law|Order) to [^\n]*|Regulations to [^\n]*)', 1) <> ''",
    "document_years": r"SELECT doc_key, coalesce(try_cast(regexp_extract(doc_key, '[/-](\d{4})$', 1) AS INT), doc_year) AS year, coalesce(try_cast(regexp_extract(doc_key, '[/-](\d{4})$', 1) AS INT) <> doc_year, false) AS differs FROM docs",
    "label_kinds": r"""
WITH o AS (SELECT unnest(['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth']) AS w, unnest(range(1, 11)) AS k),
l AS (SELECT id, dst_label, trim(dst_label) AS t, lower(regexp_extract(dst_label, '(?i)^\s*(\w+)\s+schedule', 1)) AS f FROM links)
SELECT id, CASE WHEN t IS NULL OR t = '' THEN 'whole' WHEN lower(t) LIKE '%schedule%' THEN 'schedule' WHEN regexp_matches(t, '(?i)^(part|chapter) ') THEN 'part' WHEN regexp_matches(t, '^[0-9]+[A-Za-z]*$') THEN 'section' ELSE 'other' END AS kind,
  CASE WHEN lower(t) LIKE '%schedule%' THEN array_to_string(list_transform(string_split(regexp_replace(t, '\s+', ' ', 'g'), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') END AS schedule, CAST(o.k AS INT) AS number FROM l LEFT JOIN o ON o.w = l.f""",
    "shown_titles": r"""
WITH d AS (SELECT doc_key, title, split_part(doc_key, ':', 1) AS f, split_part(doc_key, ':', 2) AS n FROM docs)
SELECT doc_key, CASE WHEN f IN ('act', 'law', 'ordinance') AND contains(n, '/') THEN upper(f[1]) || f[2:] || ', No. ' || split_part(n, '/', 1) || ' of ' || split_part(n, '/', 2) WHEN f = 'gazette' THEN 'Gazette No. ' || n WHEN f IN ('cap', 'cap1956') THEN 'Chapter ' || n
  WHEN f = 'ca' THEN 'Court of Appeal, ' || upper(n) WHEN f = 'sc' THEN 'Supreme Court, ' || upper(n) ELSE upper(doc_key[1]) || lower(doc_key[2:]) END AS shown, trim(regexp_replace(upper(title), '[^A-Z0-9]+', ' ', 'g')) AS title_key FROM d""",
    "page_ranges": f"""
WITH p AS (SELECT id, CAST(listing->>'$.pages' AS INT) AS p FROM listings), a AS (SELECT id, CASE id % 3 WHEN 2 THEN p + 2 ELSE p END AS a, CASE id % 3 WHEN 1 THEN p + 5 ELSE p END AS b FROM p)
SELECT id, CASE WHEN a BETWEEN 1 AND least(b, {LAST_PAGE}) THEN a END AS first, CASE WHEN a BETWEEN 1 AND least(b, {LAST_PAGE}) THEN least(b, {LAST_PAGE}) END AS last FROM a""",
    "text_signs": r"""
SELECT id, CASE WHEN len(regexp_extract_all(text, '\p{L}')) > 0 THEN round(len(regexp_extract_all(text, '[\x{c0}-\x{24f}]')) / len(regexp_extract_all(text, '\p{L}')), 6) END AS odd, len(regexp_extract_all(text, '“')) - len(regexp_extract_all(text, '”')) AS open,
  length(regexp_replace(regexp_replace(text, '(\p{Ll})-\n(\p{Ll})', '\1\2', 'g'), '[ \t]*\n[ \t]*', ' ', 'g')) AS characters, CAST(ceil(length(text) / 4.0) AS INT) AS tokens FROM chunks""",
    "near_citations": r"WITH m AS (SELECT unnest(regexp_extract_all(text, '[Ss]ection [0-9]+[A-Z]?[^\n]{0,12}?(?:Act|Ordinance|Schedule|of the)')) AS m FROM chunks) SELECT regexp_replace(m, '^([Ss]ection [0-9]+[A-Z]?)[^\n]*?(Act|Ordinance|Schedule|of the)$', '\1~\2') AS pair, count(*) AS n FROM m GROUP BY 1",
    "median_lines": f"WITH {_LINES} SELECT coalesce(kind, 'none') AS kind, median(length(text)) AS median, count(*) AS lines FROM bl GROUP BY 1",
    "chunks_by_id": f"WITH {LINKS} SELECT id, doc_key, seq, label, length(text) AS characters FROM chunks WHERE id IN (SELECT dst_chunk FROM l WHERE kind = 'repeals' AND dst_chunk IS NOT NULL)",
    "links_of": f"""WITH {LINKS}, u AS (SELECT 'out' AS way, src_doc AS doc, id, made_at FROM l WHERE kind IN ('amends', 'repeals') AND src_doc <> dst_doc UNION ALL SELECT 'in', dst_doc, id, made_at FROM l WHERE kind IN ('amends', 'repeals') AND src_doc <> dst_doc)
SELECT way, doc, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY way, doc ORDER BY made_at DESC NULLS LAST, id DESC) AS rank FROM u) WHERE rank <= 3 AND doc LIKE 'act:%'""",
    "history": f"""WITH {LINKS}, c AS (SELECT dst_doc, count(DISTINCT src_doc) AS laws, min(made_at) AS first_change, max(made_at) AS last_change FROM l WHERE kind IN ('replaces', 'repeals', 'inserts', 'amends') AND src_doc <> dst_doc GROUP BY dst_doc),
a AS (SELECT src_doc, arg_min(dst_doc, id) AS changes FROM l WHERE kind = 'amends_act' AND src_doc <> dst_doc GROUP BY src_doc)
SELECT d.doc_key, coalesce(laws, 0) AS laws, first_change, last_change, changes FROM docs d LEFT JOIN c ON c.dst_doc = d.doc_key LEFT JOIN a ON a.src_doc = d.doc_key""",
    "status_sentences": f"""WITH {LINKS}, {_HEADS}, w AS (SELECT id AS chunk, id AS dst_chunk FROM h UNION SELECT id, coalesce(head, id) FROM h),
c AS (SELECT w.chunk, l.kind, coalesce(l.src_chunk, l.src_doc) AS src, l.made_at FROM l JOIN w USING (dst_chunk) WHERE l.kind IN ('replaces', 'repeals', 'inserts', 'amends')),
s AS (SELECT chunk, count(DISTINCT src) AS n, max(made_at) AS last, max(CASE WHEN kind = 'repeals' THEN made_at END) AS gone FROM c GROUP BY chunk)
SELECT chunk, 'Changed by ' || n || CASE WHEN n = 1 THEN ' section' ELSE ' sections' END || coalesce(', last on ' || strftime(last, '%Y-%m-%d'), '') || coalesce('; repealed on ' || strftime(gone, '%Y-%m-%d'), '') || '.' AS status FROM s""",
    "whole_sections": """
WITH b AS (SELECT id, doc_key, seq, text, crumb LIKE '% (cont.)' AS cont, CASE WHEN crumb LIKE '% (cont.)' THEN left(crumb, length(crumb) - 8) ELSE crumb END AS base FROM chunks WHERE crumb IS NOT NULL AND text IS NOT NULL),
s AS (SELECT *, CASE WHEN NOT cont OR seq - lag(seq) OVER (PARTITION BY doc_key, base ORDER BY seq) <> 1 THEN 1 ELSE 0 END AS start FROM b),
r AS (SELECT *, sum(start) OVER (PARTITION BY doc_key, base ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_key, base, run ORDER BY seq) AS n, first_value(cont) OVER (PARTITION BY doc_key, base, run ORDER BY seq) AS headless FROM r),
t AS (SELECT arg_min(id, n) AS head, count(*) AS pieces, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text FROM p WHERE n <= 8 AND NOT headless GROUP BY doc_key, base, run)
SELECT head, pieces, length(text) AS characters, md5(text) AS hash FROM t WHERE pieces > 1""",
    "embedding_rows": "WITH r AS (SELECT id, (concat_ws(' › ', title, crumb) || chr(10) || chr(10) || text)[1:65000] AS sent FROM chunks JOIN docs USING (doc_key) WHERE length(text) >= 40) SELECT id, length(sent) AS characters, sha1(sent) AS hash FROM r",
    "builder_checks": r"""
WITH w AS (SELECT *, lead(text) OVER (PARTITION BY doc_key ORDER BY seq, id) AS following FROM chunks WHERE text IS NOT NULL),
i AS (SELECT doc_key, 'mid_sentence' AS "check", 'warning' AS severity FROM w WHERE regexp_matches(rtrim(text), '[a-z,]$') AND regexp_matches(ltrim(following), '^[a-z]')
UNION ALL SELECT doc_key, 'too_long', 'error' FROM chunks WHERE length(text) > 1500
UNION ALL SELECT doc_key, 'quoted_as_unit', 'error' FROM chunks WHERE kind = 'unit' AND regexp_matches(ltrim(text), '^[“"]')
UNION ALL SELECT doc_key, 'no_label', 'warning' FROM chunks WHERE kind = 'unit' AND label IS NULL AND coalesce(crumb NOT LIKE '% (cont.)', true)
UNION ALL SELECT doc_key, 'heading_not_scope', 'warning' FROM chunks WHERE regexp_matches(text, '(?m)^(PART|CHAPTER) [IVXL]+\s*$')
UNION ALL SELECT doc_key, 'other_script', 'warning' FROM (SELECT doc_key, len(regexp_extract_all(text, '\p{L}')) AS l, len(regexp_extract_all(text, '[\x{0D80}-\x{0DFF}\x{0B80}-\x{0BFF}]')) AS o FROM chunks WHERE text IS NOT NULL) WHERE l >= 20 AND o > 0.5 * l
UNION ALL SELECT doc_key, 'rejected_opener', 'warning' FROM chunks WHERE kind <> 'unit' AND regexp_matches(ltrim(text), '^\d{1,3}[A-Z]{0,2}\. \S')
UNION ALL SELECT doc_key, 'duplicate_label', 'error' FROM (SELECT doc_key FROM chunks WHERE label IS NOT NULL AND kind = 'unit' GROUP BY doc_key, label HAVING count(*) > 1)
UNION ALL SELECT d.doc_key, 'empty', 'error' FROM docs d WHERE d.doc_key NOT IN (SELECT doc_key FROM chunks WHERE doc_key IS NOT NULL))
SELECT "check", severity, count(*) AS issues, count(DISTINCT doc_key) AS documents FROM i GROUP BY 1, 2""",
    "gate_with_overrides": f"""WITH {_BUILDS}, b AS (SELECT doc_key FROM o INTERSECT SELECT doc_key FROM n),
a AS (SELECT doc_key, label, count(*) AS c FROM o WHERE label IS NOT NULL AND doc_key IN (SELECT * FROM b) GROUP BY ALL), z AS (SELECT doc_key, label, count(*) AS c FROM n WHERE label IS NOT NULL AND doc_key IN (SELECT * FROM b) GROUP BY ALL),
f AS (SELECT doc_key, label, coalesce(a.c, 0) - coalesce(z.c, 0) AS lost FROM a FULL OUTER JOIN z USING (doc_key, label))
SELECT doc_key, label, lost, CASE WHEN doc_key IN (SELECT doc_key FROM docs WHERE removed_at IS NOT NULL) THEN 'removed' END AS reason, doc_key NOT IN (SELECT doc_key FROM docs WHERE removed_at IS NOT NULL) AS fails FROM f WHERE lost > 0""",
    "gold_bars": f"""WITH {LINKS}, f AS (SELECT DISTINCT kind, src_doc, dst_doc, lower(trim(dst_label)) AS label FROM l WHERE dst_chunk IS NOT NULL), g AS (SELECT * FROM f WHERE label IS NOT NULL AND dst_doc IS NOT NULL),
s AS (SELECT kind, count(*) AS found, (SELECT count(*) FROM g WHERE g.kind = f.kind) AS expected FROM f GROUP BY kind)
SELECT kind, found, expected, expected AS right, round(expected / found, 6) AS precision, CASE WHEN expected > 0 THEN 1.0 END AS recall, CASE kind WHEN 'cites' THEN 0.95 ELSE 0.9 END AS bar, round(expected / found, 6) >= CASE kind WHEN 'cites' THEN 0.95 ELSE 0.9 END AS reached FROM s""",
}
