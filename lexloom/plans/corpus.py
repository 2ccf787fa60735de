"""Queries of texts, structure, citations, quality and release, office documents and streams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as t
from lexloom.functions.ids import uuid5, vector_id
from lexloom.functions.keys import plain_key
from lexloom.operators import cdc, office, quality
from lexloom.operators.citations import equal_titles as titles_shared
from lexloom.operators.citations import majority_target, mentions, name_index, named_targets, newest_not_after
from lexloom.operators.structure import build_chunks, commencement_of, paragraph_kind, paragraphs_of
from lexloom.plans.shared import LINKS, both, plain_links, plain_sql
from lexloom.sources.files import text_parts as parts_of
from lexloom.streaming import ledger
from lexloom.tables import table


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    """One text for each document: that of its last row."""
    return table(spark, folder, "documents").groupBy("doc_key").agg(F.max_by("text", "doc_id").alias("text"), F.max_by("title", "doc_id").alias("title"))


def split_long_pieces(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select("doc_id", "text")
    return t.in_parts(texts, "text", t.arrow_strings(t.split_long)(F.col("text"))).select("doc_id", "n", F.length("piece").alias("characters"))


def pages_chunks(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select("doc_id", "text")
    return t.in_parts(texts, "text", t.arrow_strings(t.pack_paragraphs)(F.col("text"))).select(F.concat_ws(":", "doc_id", "n").alias("id"), F.length("piece").alias("characters"))


def build_units(spark: SparkSession, folder: str) -> DataFrame:
    return build_chunks(_latest(spark, folder)).drop("text")


def mention_rows(spark: SparkSession, folder: str) -> DataFrame:
    found = named_targets(mentions(table(spark, folder, "chunks")), name_index(table(spark, folder, "docs")))
    return found.withColumns({"labels": F.array_join("labels", ","), "ops": F.size("ops")})


def edit_operations(spark: SparkSession, folder: str) -> DataFrame:
    """What the formulas of amending laws order to be done with words, an operation a row."""
    chunks = table(spark, folder, "chunks").where("doc_key not like 'gazette:%' and doc_key not like 'ca:%' and doc_key not like 'sc:%'")
    found = mentions(chunks).where("size(labels) = 1 and relation = 'amends'")
    return found.select("chunk", F.col("labels")[0].alias("label"), F.explode("ops").alias("o")).select("chunk", "label", "o.op", "o.old", "o.new")


def powers_used(spark: SparkSession, folder: str) -> DataFrame:
    """The sections under which texts say that something was made."""
    chunks = table(spark, folder, "chunks").where("doc_key not like 'ca:%' and doc_key not like 'sc:%'")
    found = mentions(chunks).where("relation = 'made_under' and via = 'power' and size(labels) = 1 and dst_doc like 'name:%'")
    return found.select("chunk", F.col("labels")[0].alias("label"), F.substring("dst_doc", 6, 500).alias("law"))


def amended_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The sections that the text itself says are amended, by the words of its formula alone."""
    found = F.regexp_extract_all("text", F.lit(r"Section (\d+[A-Z]?) of the ([A-Z][a-z]+ [A-Z][a-z]+ Act) is amended"), F.lit(0))
    return table(spark, folder, "chunks").select("id", F.explode(found).alias("words")).groupBy("id").agg(F.count("*").alias("sections"))


def citing_majority(spark: SparkSession, folder: str) -> DataFrame:
    """For each label the document that most links with that label mean, where it is a majority."""
    return majority_target(plain_links(spark, folder).where("dst_label is not null").select(F.col("dst_label").alias("name"), F.col("dst_doc").alias("doc_key")))


def unique_names(spark: SparkSession, folder: str) -> DataFrame:
    return name_index(table(spark, folder, "docs"))


def equal_titles(spark: SparkSession, folder: str) -> DataFrame:
    return titles_shared(table(spark, folder, "docs"))


def paragraph_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """How many paragraphs of the texts are of each kind."""

    @F.pandas_udf("array<string>")
    def kinds(texts: pd.Series) -> pd.Series:
        own = texts.map(paragraphs_of)
        return own.map(lambda ps: [paragraph_kind(p, q) for q, p in zip([None, *ps], ps, strict=False)])

    rows = table(spark, folder, "documents").where("text is not null").select("doc_type", F.explode(kinds("text")).alias("kind"))
    return rows.groupBy("doc_type", "kind").agg(F.count("*").alias("paragraphs"))


def failure_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the documents of each source without a text are within what a run may lose."""
    rows = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count(F.when(F.col("text").isNull(), 1)).alias("failed"))
    return rows.withColumn("passes", quality.within_budget(F.col("failed"), F.col("documents")))


def clean_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "listings").where("title is not null").select("id", t.clean(F.col("title")).alias("title"))


def embedding_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks in batches of at most a hundred texts and 150,000 characters, shard by shard."""
    rows = table(spark, folder, "chunks").where(F.length("text") >= 40).select((F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("long") % 64).alias("shard"), "id", F.length("text").alias("n"))

    def gather(frames):
        last, batch, size, count = None, 0, 0, 0
        for frame in frames:
            out = []
            for shard, n in zip(frame["shard"], frame["n"], strict=True):
                if shard != last or count == 100 or size + n > 150_000:
                    batch, size, count, last = (batch + 1 if shard == last else 0), 0, 0, shard
                size, count = size + n, count + 1
                out.append(batch)
            yield frame.assign(batch=out)

    placed = rows.repartition("shard").sortWithinPartitions("shard", "id").mapInPandas(gather, "shard long, id string, n int, batch int")
    return placed.groupBy("shard", "batch").agg(F.count("*").alias("texts"), F.sum("n").alias("characters"))


def commencements(spark: SparkSession, folder: str) -> DataFrame:
    """How documents say that they begin, counted."""
    how, _ = commencement_of(F.col("text"))
    return _latest(spark, folder).where("text is not null").groupBy(how.alias("how")).agg(F.count("*").alias("documents"))


def html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks wrapped as pages of HTML come out as the text that they were."""
    page = F.concat(F.lit("<html><style>p {}</style><script>var x = '<p>';</script><p>"), F.replace(F.replace("crumb", F.lit("&"), F.lit("&amp;")), F.lit("›"), F.lit("&gt;")), F.lit("</p><!-- x --><div>"), F.col("address"), F.lit("</div></html>"))
    return table(spark, folder, "chunks").where("crumb is not null").select("id", t.html_to_text(page).alias("text"))


def script_shares(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text is not null")
    return rows.select("doc_id", t.script_share(F.col("text"), "඀", "෿").alias("sinhala"), t.script_share(F.col("text"), "஀", "௿").alias("tamil"))


def titles(spark: SparkSession, folder: str) -> DataFrame:
    first, second, case = t.party_names(F.col("title"))
    return table(spark, folder, "docs").select("doc_key", t.gazette_title(F.col("title"), 30).alias("subject"), t.short_name(F.col("title")).alias("name"), first.alias("first"), second.alias("second"), case.alias("case_no"))


def natural_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's first and last label in their natural order."""
    rows = table(spark, folder, "chunks").where(F.col("label").rlike(r"^\d+[A-Z]*$")).select("doc_key", F.struct(t.natural_order(F.col("label")).alias("o"), "label").alias("l"))
    return rows.groupBy("doc_key").agg(F.min("l").alias("a"), F.max("l").alias("b")).select("doc_key", F.col("a.label").alias("first"), F.col("b.label").alias("last"))


def roman_numbers(spark: SparkSession, folder: str) -> DataFrame:
    numeral = F.regexp_extract("address", r"/Part ([IVXLCDM]+)/", 1)
    return table(spark, folder, "chunks").select(numeral.alias("numeral")).where("numeral <> ''").distinct().select("numeral", t.roman(F.col("numeral")).alias("number"))


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("id", vector_id(F.col("id")).alias("vector_id"), F.sha1("address").alias("address_hash"), uuid5(F.col("address")).alias("own_id"))


def text_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """How many chunks of each kind have the hash of their text, and how many another."""
    return table(spark, folder, "chunks").groupBy("kind", (F.sha1("text") == F.col("text_hash")).alias("right")).agg(F.count("*").alias("chunks"))


def doc_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks")
    return cdc.fingerprint(rows, ["doc_key"], F.concat_ws("|", "id", F.coalesce("label", F.lit("")), F.coalesce("text_hash", F.lit(""))), ["seq", "id"])


def _builds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The chunks as they stood at two moments."""
    rows = table(spark, folder, "chunks")
    at = lambda m: rows.where((F.col("built_at") <= F.lit(m).cast("timestamp_ntz")) & (F.col("removed_at").isNull() | (F.col("removed_at") > F.lit(m).cast("timestamp_ntz"))))
    return at("2024-01-01"), at("2025-06-01")


def bag_diff(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _builds(spark, folder)
    return cdc.bag_difference(old.select("doc_key", "kind", "part_no"), new.select("doc_key", "kind", "part_no"))


def lost_gained_labels(spark: SparkSession, folder: str) -> DataFrame:
    return quality.labels_changed(*_builds(spark, folder))


def label_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return quality.label_gaps(table(spark, folder, "chunks")).select("doc_key", F.array_join("gaps", ",").alias("gaps"))


def _issues(rows: DataFrame) -> DataFrame:
    bare = rows.where("label is null and kind = 'unit'").select("doc_key", F.lit("no_label").alias("check"), F.lit("warning").alias("severity"), F.col("address").alias("place"), F.lit("continued").alias("cause"))
    long = rows.where("length(text) > 1500").select("doc_key", F.lit("too_long"), F.lit("error"), "address", F.coalesce("kind", F.lit("none")))
    return bare.unionAll(long)


def run_diff(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _builds(spark, folder)
    return quality.run_diff(_issues(old), _issues(new), ["doc_key", "check", "place"])


def gate_summary(spark: SparkSession, folder: str) -> DataFrame:
    return quality.summary(_issues(table(spark, folder, "chunks")))


def review_list(spark: SparkSession, folder: str) -> DataFrame:
    return quality.review(_issues(table(spark, folder, "chunks")))


def gold_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that links name against those that the chunks have, by kind of document."""
    kind = lambda c: F.split(F.col(c), ":")[0].alias("family")
    found = plain_links(spark, folder).where("dst_label is not null").select(kind("dst_doc"), F.col("dst_doc").alias("doc_key"), F.col("dst_label").alias("label"))
    gold = table(spark, folder, "chunks").where("label is not null").select(kind("doc_key"), "doc_key", "label")
    return quality.gold_scores(found, gold, ["doc_key", "label"], "family")


def release_plan(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _builds(spark, folder)
    line = F.coalesce("text_hash", F.lit(""))
    was, now = cdc.fingerprint(old, ["doc_key"], line, ["seq", "id"]), cdc.fingerprint(new, ["doc_key"], line, ["seq", "id"])
    return quality.release(was, now, now.where(~F.col("doc_key").startswith("gazette:")))


def embedding_changes(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _builds(spark, folder)
    return quality.embedding_changes(old.withColumn("text_hash", F.when(F.col("seq") % 5 == 0, "old").otherwise(F.col("text_hash"))), new)


def work_plan(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "docs")
    ledger_ = rows.where("built_at < timestamp'2023-08-01'").select("doc_key", F.when(F.col("doc_year") % 7 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return cdc.planned(ledger_, rows.where("removed_at is null").select("doc_key", "fingerprint"), "doc_key", "fingerprint")


def text_parts(spark: SparkSession, folder: str) -> DataFrame:
    return parts_of(table(spark, folder, "chunks"), 20_000)


def names_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """Laws named in the texts of dated laws, each the newest of that name that isn't younger than the law that names it."""
    chunks, docs = table(spark, folder, "chunks"), table(spark, folder, "docs")
    named = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"of the ([A-Z][a-z]+ [A-Z][a-z]+ (?:Act|Ordinance))"), F.lit(1)), lambda x: F.lower(x))))
    cited = chunks.where("text is not null").select("doc_key", named.alias("name")).distinct().join(docs.where("doc_year is not null").select("doc_key", F.col("doc_year").alias("citing_year")), "doc_key")
    known = docs.select(F.lower(F.regexp_extract("title", r"^([A-Z][a-z]+ [A-Z][a-z]+ (?:Act|Ordinance))", 1)).alias("name"), F.col("doc_key").alias("law"), F.coalesce("doc_year", F.lit(0)).alias("year")).where("name <> ''")
    return newest_not_after(cited, known, ["name"], "citing_year").select("doc_key", "name", "law")


def office_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Changes between the records of a document's first and last listing, item by item."""
    items = F.from_json("listing", "map<string,string>")
    keyed = table(spark, folder, "listings").where("listing is not null and listed_key is not null").withColumn("doc_key", plain_key(F.col("listed_key")))
    rows = keyed.groupBy("doc_key").agg(F.min_by(items, F.struct("first_seen", "id")).alias("a"), F.max_by(items, F.struct("first_seen", "id")).alias("b"))
    return office.item_diff(rows.select("doc_key", F.col("a").alias("items")), rows.select("doc_key", F.col("b").alias("items")), "doc_key", "items")


def case_replay(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").select("user_id", (F.col("event_id") % 40).alias("item"), F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "add").otherwise("set").alias("op"), "ts", "event_id")
    return office.replay(log, "user_id", "item", "op", ["ts", "event_id"])


def file_states(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").select((F.col("user_id") % 50).alias("file"), F.when(F.col("event_type").isin("view", "click"), "read").otherwise("index").alias("step"), F.col("event_type").alias("state"), "ts")
    return office.file_states(log, "file", "step", "state", "ts")


def file_windows(spark: SparkSession, folder: str) -> DataFrame:
    return office.read_window(table(spark, folder, "chunks").where("text is not null"), "doc_key", ["seq", "id"], "text", 8, 4000)


def handle_map(spark: SparkSession, folder: str) -> DataFrame:
    return office.handles(plain_links(spark, folder), "src_doc", "dst_doc", ["made_at", "id"])


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.table_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Closed days of the stream; the batch answer of the days that the watermark has passed."""
    out = ledger.run_available(ledger.daily_counts(_stream(spark, folder), "ts", "event_type"), "daily", "append")
    return out.select("day", "event_type", "events", F.round("cost", 4).alias("cost"))


def stream_once(spark: SparkSession, folder: str) -> DataFrame:
    """Events appended once by their id, from a stream."""
    doubled = _stream(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return ledger.run_available(ledger.once(doubled, "event_id", "ts", "60 days"), "once", "append").groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))


def stream_states(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of each user, kept by a stateful operator."""
    out = ledger.run_available(ledger.newest_states(_stream(spark, folder), "user_id", "event_type", "ts"), "states", "update")
    return out.groupBy("user_id").agg(F.max(F.struct("at_us", "state")).alias("m")).select("user_id", F.col("m.state").alias("state"), F.col("m.at_us").alias("at_us"))


_embed, _embed_sql = both("""
SELECT c.id, length(concat_ws(' › ', d.title, c.crumb)) AS heading, CAST(ceil(length(c.text) / 4.0) AS BIGINT) AS tokens, length(c.text) >= 40 AS embedded
FROM {chunks} c JOIN {docs} d ON d.doc_key = c.doc_key WHERE c.text IS NOT NULL
""")
_same_text, _same_text_sql = both("""
SELECT a.doc_key, count(*) AS chunks, count(b.text_hash) AS elsewhere FROM {chunks} a LEFT JOIN (SELECT DISTINCT text_hash, doc_key FROM {chunks}) b ON b.text_hash = a.text_hash AND b.doc_key <> a.doc_key GROUP BY a.doc_key
""")
_sets, _sets_sql = both("""
(SELECT doc_key FROM {docs} WHERE removed_at IS NULL INTERSECT SELECT doc_key FROM {documents}) EXCEPT SELECT doc_key FROM {chunks} WHERE kind = 'schedule'
""")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "split_long_pieces": split_long_pieces, "pages_chunks": pages_chunks, "tree_units": build_units, "paragraph_kinds": paragraph_kinds, "failure_budget": failure_budget, "clean_titles": clean_titles, "embedding_batches": embedding_batches, "edit_operations": edit_operations, "powers_used": powers_used, "mention_rows": mention_rows, "amended_sections": amended_sections, "citing_majority": citing_majority,
    "unique_names": unique_names, "equal_titles": equal_titles, "commencements": commencements, "html_to_text": html_text, "script_share": script_shares, "display_titles": titles, "natural_labels": natural_labels, "roman_numbers": roman_numbers, "chunk_ids": chunk_ids,
    "text_hash_check": text_hashes, "doc_fingerprint": doc_fingerprint, "bag_diff": bag_diff, "lost_gained_labels": lost_gained_labels, "label_gaps": label_gaps, "run_diff": run_diff, "gate_summary": gate_summary,
    "review_list": review_list, "gold_precision_recall": gold_scores, "release_plan": release_plan, "embedding_changes": embedding_changes, "work_plan": work_plan, "text_parts": text_parts, "names_as_of": names_as_of, "office_diff": office_diff,
    "case_replay": case_replay, "file_states": file_states, "file_windows": file_windows, "handle_map": handle_map, "stream_daily_counts": stream_daily_counts, "stream_once": stream_once, "stream_states": stream_states,
    "embedding_texts": _embed, "same_text_elsewhere": _same_text, "set_operations": _sets,
}

BUILDS = """o AS (SELECT * FROM chunks WHERE built_at <= TIMESTAMP '2024-01-01' AND (removed_at IS NULL OR removed_at > TIMESTAMP '2024-01-01')),
n AS (SELECT * FROM chunks WHERE built_at <= TIMESTAMP '2025-06-01' AND (removed_at IS NULL OR removed_at > TIMESTAMP '2025-06-01'))"""
ISSUES = "SELECT doc_key, 'no_label' AS \"check\", 'warning' AS severity, address AS place, 'continued' AS cause FROM {0} WHERE label IS NULL AND kind = 'unit' UNION ALL SELECT doc_key, 'too_long', 'error', address, coalesce(kind, 'none') FROM {0} WHERE length(text) > 1500"

_SHORT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '\([^)]*\)|,? *no\. *\d+( of \d{4})?', ' ', 'g'), '[’'']s\b', '', 'g'), '^ *the ', ''), '[^a-z0-9 ]+', ' ', 'g'), '( (act|law|ordinance|code))+ *$', ''), ' +', ' ', 'g'))"
_PARTIES = r"'^(.*?) v\. (.*?), ([A-Z][A-Z-]*-\d+-\d{4})\.?$'"

ORACLE: dict[str, str] = {
    "powers_used": r"""
WITH f AS (SELECT id, unnest(regexp_extract_all(text, '\b(?:made|issued|published|prescribed|framed)\s+under\s+(?:the\s+)?[Ss]ections?\s+\d{1,4}[A-Z]{0,2}\s*,?\s*(?:of|to|in|under)\s+(?:the\s+)?(?:[A-Z][\w’''-]*\s+)(?:(?:[A-Z][\w’''-]*|of|and|for|\([A-Z][\w ]*\))\s+){0,8}?(?:Act|Law|Ordinance)\b')) AS t FROM chunks WHERE NOT regexp_matches(doc_key, '^(ca|sc):'))
SELECT id AS chunk, regexp_extract(t, 'ections?\s+(\d{1,4}[A-Z]{0,2})', 1) AS label, regexp_replace(lower(regexp_extract(t, '(?s)^.*?\d[A-Z]{0,2}\s*,?\s*(?:of|to|in|under)\s+(?:the\s+)?([A-Z].*)$', 1)), '\s+', ' ', 'g') AS law FROM f""",
    "embedding_batches": """
WITH RECURSIVE s AS (SELECT CAST('0x' || md5(id)[1:2] AS BIGINT) % 64 AS shard, id, CAST(length(text) AS BIGINT) AS size FROM chunks WHERE length(text) >= 40),
o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY id) AS n FROM s),
w AS (SELECT shard, n, size, CAST(0 AS BIGINT) AS batch, size AS held, CAST(1 AS BIGINT) AS texts FROM o WHERE n = 1
  UNION ALL SELECT o.shard, o.n, o.size, CASE WHEN w.texts = 100 OR w.held + o.size > 150000 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.texts = 100 OR w.held + o.size > 150000 THEN o.size ELSE w.held + o.size END, CASE WHEN w.texts = 100 OR w.held + o.size > 150000 THEN 1 ELSE w.texts + 1 END FROM w JOIN o ON o.shard = w.shard AND o.n = w.n + 1)
SELECT shard, CAST(batch AS INT) AS batch, count(*) AS texts, sum(size) AS characters FROM w GROUP BY shard, batch""",
    "names_as_of": r"""
WITH c AS (SELECT DISTINCT c.doc_key, lower(n) AS name, d.doc_year AS y FROM (SELECT doc_key, unnest(regexp_extract_all(text, 'of the ([A-Z][a-z]+ [A-Z][a-z]+ (?:Act|Ordinance))', 1)) AS n FROM chunks WHERE text IS NOT NULL) c JOIN docs d ON d.doc_key = c.doc_key AND d.doc_year IS NOT NULL),
k AS (SELECT lower(regexp_extract(title, '^([A-Z][a-z]+ [A-Z][a-z]+ (?:Act|Ordinance))', 1)) AS name, doc_key AS law, coalesce(doc_year, 0) AS year FROM docs)
SELECT doc_key, name, law FROM (SELECT c.doc_key, c.name, k.law, row_number() OVER (PARTITION BY c.doc_key, c.name ORDER BY k.year DESC, k.law DESC) AS p FROM c JOIN k ON k.name = c.name AND k.year <= c.y AND k.name <> '') WHERE p = 1""",
    "commencements": r"""
WITH d AS (SELECT doc_key, arg_max_null(text, doc_id) AS text FROM documents GROUP BY doc_key),
m AS (SELECT lower(regexp_extract(text, '(?i)((?:deemed to have )?(?:come|came|operate|take effect|taken effect)\w* [^.]{0,60}?\bon (?:(?:the )?date (?:on which )?the certificate|such date|(?:the )?\d{1,2}(?:st|nd|rd|th)?(?: day of)? [A-Z][a-z]+,? \d{4}))', 1)) AS w FROM d WHERE text IS NOT NULL)
SELECT CASE WHEN w = '' THEN 'unstated' WHEN contains(w, 'certificate') THEN 'certified' WHEN contains(w, 'such date') THEN 'appointed' WHEN starts_with(w, 'deemed') THEN 'deemed' ELSE 'date' END AS how, count(*) AS documents FROM m GROUP BY 1""",
    "display_titles": rf"""
WITH t AS (SELECT doc_key, title, trim(regexp_replace(title, ' *- *Gazette No\..*$', '')) AS s FROM docs)
SELECT doc_key, CASE WHEN length(s) <= 30 THEN s ELSE regexp_replace(s[1:30], ' +[^ ]*$', '') || '…' END AS subject, {_SHORT} AS name, regexp_extract(title, {_PARTIES}, 1) AS first, regexp_extract(title, {_PARTIES}, 2) AS second, regexp_extract(title, {_PARTIES}, 3) AS case_no FROM t""",
    "roman_numbers": r"""
WITH n AS (SELECT DISTINCT regexp_extract(address, '/Part ([IVXLCDM]+)/', 1) AS numeral FROM chunks), v AS (SELECT numeral, list_transform(string_split(numeral, ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END) AS d FROM n WHERE numeral <> '')
SELECT numeral, CAST(list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i < len(d) AND d[i] < d[i + 1] THEN -d[i] ELSE d[i] END)) AS INT) AS number FROM v""",
    "chunk_ids": r"""
WITH h AS (SELECT id, address, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(address)) AS s FROM chunks)
SELECT id, CAST('0x' || left(replace(id, '-', ''), 12) AS BIGINT) + (1::BIGINT << 50) AS vector_id, sha1(address) AS address_hash, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || ('89ab')[(CAST('0x' || s[17:17] AS INT) & 3) + 1] || s[18:20] || '-' || s[21:32] AS own_id FROM h""",
    "failure_budget": "SELECT source, count(*) AS documents, count(*) FILTER (WHERE text IS NULL) AS failed, count(*) FILTER (WHERE text IS NULL) <= greatest(3, count(*) * 0.01) AS passes FROM documents GROUP BY source",
    "clean_titles": r"SELECT id, trim(regexp_replace(regexp_replace(title, '\s+', ' ', 'g'), ' ([.,;:])', '\1', 'g')) AS title FROM listings WHERE title IS NOT NULL",
    "edit_operations": r"""
WITH f AS (SELECT id, unnest(regexp_extract_all(text, '[Ss]ections?\s+\d{1,4}[A-Z]{0,2}\s+of\s+(?:the\s+)?(?:[A-Z][\w’''-]*\s+)(?:(?:[A-Z][\w’''-]*|of|and|for|\([A-Z][\w ]*\))\s+){0,8}?(?:Act|Law|Ordinance)\s+is\s+amended\b[^“.;]*?substitution[^“.;]*?,?\s*for\s+the\s+words?\s+“[^”]+”,?\s*of\s+the\s+words?\s+“[^”]+”')) AS t
  FROM chunks WHERE NOT regexp_matches(doc_key, '^(gazette|ca|sc):'))
SELECT id AS chunk, regexp_extract(t, '(\d{1,4}[A-Z]{0,2})', 1) AS label, 'substitute' AS op, regexp_extract(t, '“([^”]+)”', 1) AS old, regexp_extract(t, '“[^”]+”[^“]*“([^”]+)”', 1) AS new FROM f""".replace("\\\\", "\\"),
    "amended_sections": "SELECT id, len(f) AS sections FROM (SELECT id, regexp_extract_all(text, 'Section (\\d+[A-Z]?) of the ([A-Z][a-z]+ [A-Z][a-z]+ Act) is amended') AS f FROM chunks) WHERE len(f) > 0",
    "citing_majority": f"WITH {LINKS}, v AS (SELECT dst_label AS name, dst_doc AS doc_key, count(*) AS n FROM l WHERE dst_label IS NOT NULL GROUP BY ALL) SELECT name, arg_max(doc_key, n) AS doc_key FROM v GROUP BY name HAVING max(n) > sum(n) - max(n)",
    "unique_names": "SELECT name, min(doc_key) AS doc_key, max(doc_year) AS year FROM (SELECT lower(regexp_extract(title, '^(?:The )?(.*?(?:Act|Law|Ordinance))\\b', 1)) AS name, doc_key, doc_year FROM docs WHERE title IS NOT NULL) WHERE name <> '' GROUP BY name HAVING min(doc_key) = max(doc_key)",
    "equal_titles": "SELECT min(doc_key) AS doc, max(doc_key) AS twin FROM (SELECT lower(regexp_replace(title, '\\s+', ' ', 'g')) AS t, doc_key FROM docs WHERE title IS NOT NULL) GROUP BY t HAVING count(DISTINCT doc_key) = 2 AND split_part(min(doc_key), ':', 1) <> split_part(max(doc_key), ':', 1)",
    "html_to_text": "SELECT id, replace(crumb, '›', '>') || chr(10) || chr(10) || address AS text FROM chunks WHERE crumb IS NOT NULL",
    "script_share": r"""SELECT doc_id, CASE WHEN n >= 200 THEN round(s / n, 6) END AS sinhala, CASE WHEN n >= 200 THEN round(t / n, 6) END AS tamil FROM (SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) AS n,
  len(list_filter(regexp_extract_all(text, '\p{L}'), lambda x: regexp_matches(x, '[\x{0D80}-\x{0DFF}]'))) AS s, len(list_filter(regexp_extract_all(text, '\p{L}'), lambda x: regexp_matches(x, '[\x{0B80}-\x{0BFF}]'))) AS t FROM documents WHERE text IS NOT NULL)""",
    "natural_labels": r"SELECT doc_key, arg_min(label, (CAST(regexp_extract(label, '^(\d+)', 1) AS INT), regexp_extract(label, '^\d*(.*)$', 1))) AS first, arg_max(label, (CAST(regexp_extract(label, '^(\d+)', 1) AS INT), regexp_extract(label, '^\d*(.*)$', 1))) AS last FROM chunks WHERE regexp_matches(label, '^\d+[A-Z]*$') GROUP BY doc_key",
    "text_hash_check": "SELECT kind, sha1(text) = text_hash AS right, count(*) AS chunks FROM chunks GROUP BY ALL",
    "doc_fingerprint": "SELECT doc_key, md5(string_agg(h, chr(10) ORDER BY b)) AS fingerprint FROM (SELECT doc_key, seq // 1000 AS b, md5(string_agg(concat_ws('|', id, coalesce(label, ''), coalesce(text_hash, '')), chr(10) ORDER BY seq, id)) AS h FROM chunks GROUP BY 1, 2) GROUP BY doc_key",
    "bag_diff": f"WITH {BUILDS}, a AS (SELECT doc_key, kind, part_no, count(*) AS c FROM o GROUP BY ALL), b AS (SELECT doc_key, kind, part_no, count(*) AS c FROM n GROUP BY ALL) SELECT coalesce(a.doc_key, b.doc_key) AS doc_key, coalesce(a.kind, b.kind) AS kind, coalesce(a.part_no, b.part_no) AS part_no, greatest(coalesce(a.c, 0) - coalesce(b.c, 0), 0) AS lost, greatest(coalesce(b.c, 0) - coalesce(a.c, 0), 0) AS gained FROM a FULL OUTER JOIN b ON a.doc_key = b.doc_key AND a.kind IS NOT DISTINCT FROM b.kind AND a.part_no IS NOT DISTINCT FROM b.part_no WHERE coalesce(a.c, 0) <> coalesce(b.c, 0)",
    "lost_gained_labels": f"WITH {BUILDS}, s AS (SELECT doc_key FROM o INTERSECT SELECT doc_key FROM n), u AS (SELECT doc_key, label, 1 AS x, 0 AS y FROM o WHERE label IS NOT NULL UNION ALL SELECT doc_key, label, 0, 1 FROM n WHERE label IS NOT NULL) SELECT doc_key, label, greatest(sum(x) - sum(y), 0) AS lost, greatest(sum(y) - sum(x), 0) AS gained FROM u WHERE doc_key IN (SELECT doc_key FROM s) GROUP BY doc_key, label HAVING sum(x) <> sum(y)",
    "label_gaps": r"WITH u AS (SELECT doc_key, list(DISTINCT CAST(regexp_extract(label, '^(\d{1,4})', 1) AS INT)) AS l FROM chunks WHERE kind = 'unit' AND regexp_matches(label, '^\d{1,4}') GROUP BY doc_key), g AS (SELECT doc_key, list_filter(range(1, list_max(l) + 1), lambda i: NOT list_contains(l, i)) AS g FROM u) SELECT doc_key, array_to_string(g, ',') AS gaps FROM g WHERE len(g) > 0",
    "run_diff": f"""WITH {BUILDS}, a AS ({ISSUES.format('o')}), b AS ({ISSUES.format('n')}), k AS (SELECT doc_key FROM a INTERSECT SELECT doc_key FROM b)
SELECT doc_key, "check", place, 'fixed' AS state FROM (SELECT DISTINCT doc_key, "check", place FROM a EXCEPT SELECT doc_key, "check", place FROM b) WHERE doc_key IN (SELECT doc_key FROM k) UNION ALL
SELECT doc_key, "check", place, 'new' FROM (SELECT DISTINCT doc_key, "check", place FROM b EXCEPT SELECT doc_key, "check", place FROM a) WHERE doc_key IN (SELECT doc_key FROM k)""",
    "gate_summary": f"""WITH i AS ({ISSUES.format('chunks')}), c AS (SELECT "check", severity, cause, count(*) AS n FROM i GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY "check", severity ORDER BY n DESC, cause) AS p FROM c)
SELECT i."check", i.severity, count(*) AS issues, count(DISTINCT doc_key) AS documents, any_value(x.causes) AS causes FROM i LEFT JOIN (SELECT "check", severity, string_agg(cause || '=' || n, ',' ORDER BY p) AS causes FROM p WHERE p <= 4 GROUP BY ALL) x ON x."check" = i."check" AND x.severity = i.severity GROUP BY i."check", i.severity""",
    "review_list": f"WITH i AS ({ISSUES.format('chunks')}) SELECT doc_key, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM i GROUP BY doc_key ORDER BY errors DESC, warnings DESC, doc_key LIMIT 60",
    "gold_precision_recall": f"WITH {LINKS}, f AS (SELECT DISTINCT split_part(dst_doc, ':', 1) AS family, dst_doc AS doc_key, dst_label AS label FROM l WHERE dst_label IS NOT NULL), g AS (SELECT DISTINCT split_part(doc_key, ':', 1) AS family, doc_key, label FROM chunks WHERE label IS NOT NULL) SELECT coalesce(f.family, g.family) AS family, count(f.family) AS found, count(g.family) AS expected, count(CASE WHEN f.family IS NOT NULL AND g.family IS NOT NULL THEN 1 END) AS \"right\", round(count(CASE WHEN f.family IS NOT NULL AND g.family IS NOT NULL THEN 1 END) / nullif(count(f.family), 0), 6) AS precision, round(count(CASE WHEN f.family IS NOT NULL AND g.family IS NOT NULL THEN 1 END) / nullif(count(g.family), 0), 6) AS recall FROM f FULL OUTER JOIN g ON f.family = g.family AND f.doc_key = g.doc_key AND f.label = g.label GROUP BY 1",
    "release_plan": f"""WITH {BUILDS}, a AS (SELECT doc_key, md5(string_agg(coalesce(text_hash, ''), chr(10) ORDER BY seq, id)) AS x FROM o GROUP BY doc_key), b AS (SELECT doc_key, md5(string_agg(coalesce(text_hash, ''), chr(10) ORDER BY seq, id)) AS y FROM n GROUP BY doc_key)
SELECT coalesce(a.doc_key, b.doc_key) AS doc_key, CASE WHEN y IS NULL THEN 'remove' WHEN x = y THEN 'keep' WHEN b.doc_key NOT LIKE 'gazette:%' THEN 'replace' ELSE 'hold' END AS action FROM a FULL OUTER JOIN b ON a.doc_key = b.doc_key""",
    "embedding_changes": f"WITH {BUILDS}, h AS (SELECT id, CASE WHEN seq % 5 = 0 THEN 'old' ELSE text_hash END AS was FROM o), d AS (SELECT id, text_hash AS due FROM n WHERE length(text) >= 40) SELECT * FROM (SELECT coalesce(h.id, d.id) AS id, CASE WHEN due IS NULL THEN 'delete' WHEN due IS DISTINCT FROM was THEN 'upsert' END AS action FROM h FULL OUTER JOIN d ON h.id = d.id) WHERE action IS NOT NULL",
    "work_plan": "WITH a AS (SELECT doc_key, CASE WHEN doc_year % 7 = 0 THEN 'old' ELSE fingerprint END AS done FROM docs WHERE built_at < TIMESTAMP '2023-08-01'), b AS (SELECT doc_key, fingerprint AS due FROM docs WHERE removed_at IS NULL) SELECT coalesce(a.doc_key, b.doc_key) AS doc_key, CASE WHEN b.doc_key IS NULL THEN 'retire' WHEN a.doc_key IS NULL THEN 'new' WHEN done IS NOT DISTINCT FROM due THEN 'done' ELSE 'redo' END AS plan FROM a FULL OUTER JOIN b ON a.doc_key = b.doc_key",
    "text_parts": """
WITH RECURSIVE s AS (SELECT doc_key, seq, id, strlen(text) AS size, sha256(text) AS hash, row_number() OVER (PARTITION BY doc_key ORDER BY seq, id) AS n FROM chunks WHERE text IS NOT NULL AND doc_key IS NOT NULL),
w AS (SELECT doc_key, n, seq, id, size, hash, 0 AS part, CAST(size AS BIGINT) AS held FROM s WHERE n = 1
  UNION ALL SELECT s.doc_key, s.n, s.seq, s.id, s.size, s.hash, CASE WHEN w.held > 0 AND w.held + s.size > 20000 THEN w.part + 1 ELSE w.part END, CASE WHEN w.held > 0 AND w.held + s.size > 20000 THEN s.size ELSE w.held + s.size END FROM w JOIN s ON s.doc_key = w.doc_key AND s.n = w.n + 1)
SELECT doc_key, part, min(seq) AS first_seq, count(*) AS chunks, sum(size) AS bytes, sha256(string_agg(hash, '' ORDER BY seq, id)) AS name FROM w GROUP BY doc_key, part""",
    "file_states": "SELECT user_id % 50 AS file, CASE WHEN event_type IN ('view', 'click') THEN 'read' ELSE 'index' END AS step, arg_max(event_type, (ts, event_type)) AS state, max(ts) AS ts FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "office_diff": f"""WITH k AS (SELECT *, {plain_sql('listed_key')} AS doc_key FROM listings WHERE listed_key IS NOT NULL AND listing IS NOT NULL),
f AS (SELECT doc_key, arg_min(listing, (first_seen, id)) AS a, arg_max(listing, (first_seen, id)) AS b FROM k GROUP BY doc_key), i AS (SELECT unnest(['record', 'description', 'pages']) AS item)
SELECT doc_key, item, CASE WHEN json_extract_string(a, '$.' || item) IS NULL THEN 'added' WHEN json_extract_string(b, '$.' || item) IS NULL THEN 'removed' ELSE 'changed' END AS change FROM f, i
WHERE json_extract_string(a, '$.' || item) IS DISTINCT FROM json_extract_string(b, '$.' || item)""",
    "case_replay": "WITH g AS (SELECT user_id, event_id % 40 AS item, CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'add' ELSE 'set' END AS op, row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, count(*) FILTER (WHERE n = 1 AND op <> 'remove') AS items, count(*) FILTER (WHERE n = 1 AND op = 'remove') AS removed, count(*) AS version FROM g GROUP BY user_id",
    "file_windows": "WITH w AS (SELECT doc_key, row_number() OVER (PARTITION BY doc_key ORDER BY seq, id) AS n, sum(length(text)) OVER (PARTITION BY doc_key ORDER BY seq, id ROWS UNBOUNDED PRECEDING) AS s FROM chunks WHERE text IS NOT NULL) SELECT doc_key, count(*) FILTER (WHERE n = 1 OR n <= 8 AND s <= 4000) AS shown, count(*) > count(*) FILTER (WHERE n = 1 OR n <= 8 AND s <= 4000) AS more FROM w GROUP BY doc_key",
    "handle_map": f"WITH {LINKS}, f AS (SELECT src_doc, dst_doc, min((made_at, id)) AS first FROM l WHERE dst_doc IS NOT NULL GROUP BY ALL) SELECT src_doc, dst_doc, row_number() OVER (PARTITION BY src_doc ORDER BY first) AS handle FROM f",
    "stream_daily_counts": "WITH d AS (SELECT CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, event_type, count(*) AS events, round(sum(value), 4) AS cost FROM events GROUP BY 1, 2) SELECT * FROM d WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 330 MINUTE <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)",
    "stream_once": "SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type",
    "stream_states": "SELECT user_id, arg_max(event_type, (ts, event_type)) AS state, epoch_us(max(ts)) AS at_us FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "embedding_texts": _embed_sql, "same_text_elsewhere": _same_text_sql, "set_operations": _sets_sql,
}
