"""Queries of sources and choices of files: typing, candidates, upserts, manifests, backfill, sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.keys import plain_key, plain_label
from lexloom.operators import cdc
from lexloom.operators.best import best_per_key
from lexloom.operators.skew import spread_join
from lexloom.plans.shared import both, plain_sql
from lexloom.sources.files import read_back, write_run
from lexloom.tables import shared_folder, table


def _listings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "listings").withColumn("doc_key", plain_key(F.col("listed_key")))


def _label(column: str = "language"):
    label = plain_label(F.col(column))
    return F.when(label.isin("english", "eng", "en"), "ENGLISH").when(label.isin("sinhala", "sin", "si"), "SINHALA").when(label.isin("tamil", "tam", "ta"), "TAMIL")


def candidate_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """All candidates of a document in order: language, trust of the source, later sight, higher id."""
    trust = table(spark, folder, "sources").select("source", "trust")
    ranked = _listings(spark, folder).where("doc_key is not null").join(trust, "source", "left").withColumn("lang", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in {"ENGLISH": 0, "SINHALA": 1, "TAMIL": 2}.items() for x in kv]), _label()), F.lit(3)))
    order = Window.partitionBy("doc_key").orderBy("lang", F.asc_nulls_last("trust"), F.desc_nulls_last("last_seen"), F.desc("id"))
    return ranked.select("doc_key", "id", F.row_number().over(order).alias("place"))


def best_candidate(spark: SparkSession, folder: str) -> DataFrame:
    """The first candidate of each document by an aggregate of structs, with the columns of its row."""
    rows = _listings(spark, folder).where("doc_key is not null").select("doc_key", "id", "source", "file_format", F.coalesce(_label(), F.lit("~")).alias("label"), "last_seen")
    return best_per_key(rows, ["doc_key"], [F.col("label"), -F.unix_micros(F.col("last_seen").cast("timestamp")), -F.col("id")]).select("doc_key", "id", "source", "file_format")


def choice_report(spark: SparkSession, folder: str) -> DataFrame:
    """How the chosen listing of each document stands to the one it was written with."""
    best = best_candidate(spark, folder).select("doc_key", F.col("id").alias("chosen"))
    now = table(spark, folder, "documents").groupBy("doc_key").agg(F.max_by("listing_id", "doc_id").alias("held"))
    state = F.when(F.col("chosen").isNull(), "only_held").when(F.col("held").isNull(), "only_new").when(F.col("chosen") == F.col("held"), "same").otherwise("differs")
    return now.join(best, "doc_key", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("documents"))


def _snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents, the earlier without what came later and with another source where the id ends in 7."""
    rows = table(spark, folder, "documents").select("doc_id", "doc_key", "source", "sha256", "lang", "updated_at")
    cut = F.lit("2025-01-01").cast("timestamp")
    old = rows.where(F.col("updated_at") < cut).withColumn("source", F.when(F.col("doc_id") % 10 == 7, "elsewhere").otherwise(F.col("source")))
    return old, rows.where("doc_id % 11 <> 0")


def upsert_changes(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _snapshots(spark, folder)
    return cdc.classify(old, new, ["doc_id"])


def upserted(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _snapshots(spark, folder)
    return cdc.upsert(old, new, ["doc_id"]).select("doc_id", "source", "lang")


def canonical_record(spark: SparkSession, folder: str) -> DataFrame:
    """Each record as JSON with its keys in order, and its hash, so that unchanged records compare equal."""
    entries = F.array_sort(F.map_entries(F.from_json("listing", "map<string,string>")))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")
    return table(spark, folder, "listings").select("id", F.md5(text).alias("record"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """For each file the listings that hold it, in order: files are one by their content's hash."""
    held = table(spark, folder, "documents").where("sha256 is not null and listing_id is not null").select("sha256", "listing_id").distinct()
    return held.groupBy("sha256").agg(F.array_join(F.transform(F.array_sort(F.collect_list("listing_id")), lambda x: x.cast("string")), ",").alias("listings"), F.count("*").alias("n"))


def unshared_files(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of removed documents that no other document still has."""
    docs = table(spark, folder, "docs")
    gone = docs.where("removed_at is not null and sha256 is not null").select("sha256").distinct()
    return gone.join(docs.where("removed_at is null").select("sha256"), "sha256", "left_anti")


def run_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """A crawl's rows written as compressed JSON lines and read again: rows and hashes of each source must be as before."""
    rows = table(spark, folder, "listings").select("id", "source", "source_url", "doc_type", "listed_key", "title", "date", "language")
    back = read_back(spark, write_run(rows, "listings"), rows.schema)
    return back.groupBy("source").agg(F.count("*").alias("rows"), F.count("title").alias("titles"), F.max("id").alias("last_id"))


def landed_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Listings through the Python data source, with the lines that couldn't be read."""
    from lexloom.sources.listing_source import ListingSource

    spark.dataSource.register(ListingSource)
    path = write_run(table(spark, folder, "listings").select("source", "source_url", "title", "date", "listing").repartition(3), "landed")
    return spark.read.format("landed_listings").option("path", path).load().groupBy("source").agg(F.count("*").alias("rows"), F.count("title").alias("titles"), F.count("unread").alias("unread"))


def landed_of_source(spark: SparkSession, folder: str) -> DataFrame:
    """Listings of one source through the data source, whose reader leaves out the others."""
    from lexloom.sources.listing_source import ListingSource

    spark.dataSource.register(ListingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = write_run(table(spark, folder, "listings").select("source", "source_url", "title", "date", "listing").repartition(3), "landed")
    rows = spark.read.format("landed_listings").option("path", path).option("pushdown", "true").load().where("source = 'state-press'")
    return rows.groupBy("date").agg(F.count("*").alias("rows"))


def mirror_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of a mirror as tab-separated text: its rows whose address no listing of another source has, the last row of each."""
    index = table(spark, folder, "listings").where("source = 'bundle-archive'").select("source_url", "listed_key", "id")
    path = f"{shared_folder(spark)}/mirror-{uuid.uuid4().hex}"
    as_is = {"sep": "\t", "header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    index.write.options(**as_is).csv(path)
    mirror = spark.read.options(**as_is).schema(index.schema).csv(path)
    others = table(spark, folder, "listings").where("source <> 'bundle-archive'").select("source_url")
    return mirror.join(others, "source_url", "left_anti").groupBy("source_url").agg(F.max_by("listed_key", "id").alias("listed_key"), F.max("id").alias("id"))


def json_paths(spark: SparkSession, folder: str) -> DataFrame:
    """What the JSON of listings holds, by path, key, type and merge with another."""
    v = F.try_parse_json("listing")
    laid = F.map_concat(F.map_filter(F.from_json("listing", "map<string,string>"), lambda k, x: k != "pages"), F.create_map(F.lit("pages"), F.lit("0")))
    kind = F.schema_of_variant(F.try_variant_get(v, "$.pages", "variant"))
    return table(spark, folder, "listings").select("id", F.try_variant_get(v, "$.record", "long").alias("record"), F.map_contains_key(F.from_json("listing", "map<string,string>"), "pages").alias("has_pages"), F.when(kind == "BIGINT", "number").when(kind == "STRING", "text").alias("kind"), laid["pages"].alias("pages"), F.size(laid).alias("keys"))


_types, _types_sql = both(r"""
SELECT id, CASE WHEN regexp_like(lower(listed_key), '^ *(act|law|ordinance|cap|cap1956|constitution)') THEN 'law' WHEN lower(trim(listed_key)) LIKE 'gazette:%' THEN 'gazette'
  WHEN regexp_like(lower(listed_key), '^ *(ca|sc) *:') THEN 'judgment' ELSE 'other' END AS type,
  CASE WHEN source_url LIKE '%\_S.%' ESCAPE '\' THEN 'SINHALA' WHEN source_url LIKE '%\_T.%' ESCAPE '\' THEN 'TAMIL' WHEN source_url LIKE '%\_E.%' ESCAPE '\' THEN 'ENGLISH' END AS url_language
FROM {listings}
""".replace("ESCAPE '\\'", "ESCAPE '~'").replace("%\\_", "%~_"))
_is_law, _is_law_sql = both("""
SELECT id, lower(coalesce(title, '')) LIKE '%act%' OR lower(coalesce(title, '')) LIKE '%ordinance%' OR lower(coalesce(title, '')) LIKE '%law%' AS names_law,
  (lower(title) LIKE '%act%' OR lower(title) LIKE '%ordinance%') AND NOT (lower(title) LIKE '%gazette%' OR lower(title) LIKE '%notification%') AS is_law FROM {listings}
""")
_all_words, _all_words_sql = both("""
SELECT doc_key, title FROM {docs} WHERE title ILIKE '%special%' AND title ILIKE '%act%' AND title ILIKE '%no. 1%' AND doc_year BETWEEN 1950 AND 2010
""")
_years, _years_sql = both("""
SELECT y.year, d.docs IS NOT NULL AND y.year <> 2026 AND y.year <> 2025 AS skip, coalesce(d.docs, 0) AS docs
FROM (SELECT explode(sequence(1990, 2026)) AS year) y LEFT JOIN (SELECT doc_year, count(*) AS docs FROM {docs} GROUP BY doc_year) d ON d.doc_year = y.year
""")
_shards, _shards_sql = both("""
SELECT source, count(*) AS files, count(DISTINCT doc_type) AS types, sum(CASE WHEN file_format = 'pdf' THEN 1 ELSE 0 END) AS pdf, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM {listings} GROUP BY source
""")
_duplicates, _duplicates_sql = both("""
SELECT source_url, count(*) AS times, min(id) AS first_id, max(id) AS last_id FROM {listings} GROUP BY source_url HAVING count(*) > 1
""")


def same_file(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose file an earlier one holds already, with the first that does: one minimum a hash, joined back."""
    held = table(spark, folder, "documents").where("sha256 is not null").select("doc_id", "sha256")
    first = held.groupBy(F.col("sha256").alias("file")).agg(F.min("doc_id").alias("same_file"), F.count("*").alias("rows"))
    return spread_join(held, first, "sha256", "rows", ["same_file"]).where("same_file < doc_id").select("doc_id", "same_file").distinct()


def backfill(spark: SparkSession, folder: str) -> DataFrame:
    """For each key listed that no document has, in plain spelling, the listing seen last, of equal ones the first id."""
    held = table(spark, folder, "documents").select(plain_key(F.col("doc_key")).alias("doc_key"))
    missing = _listings(spark, folder).where("doc_key is not null").join(held, "doc_key", "left_anti")
    return missing.groupBy("doc_key").agg(F.max_by("id", F.struct(F.col("last_seen"), (-F.col("id")).alias("i"))).alias("id"))


def sharding(spark: SparkSession, folder: str) -> DataFrame:
    from lexloom.functions.ids import shard

    return table(spark, folder, "documents").where("sha256 is not null").groupBy(shard(F.col("sha256"), 16).alias("shard")).agg(F.count("*").alias("files"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "candidate_ranking": candidate_ranking,
    "best_candidate_per_key": best_candidate,
    "choice_report": choice_report,
    "changed_rows_cdc": upsert_changes,
    "upsert_snapshot": upserted,
    "canonical_record": canonical_record,
    "file_manifest": manifest,
    "unshared_files": unshared_files,
    "run_snapshot": run_snapshot,
    "landed_listings": landed_listings,
    "landed_of_source": landed_of_source,
    "mirror_index": mirror_index,
    "json_paths": json_paths,
    "listing_types": _types,
    "is_law": _is_law,
    "filter_all_words": _all_words,
    "years_to_crawl": _years,
    "backfill_todo": backfill,
    "same_file": same_file,
    "files_by_source": _shards,
    "listed_again": _duplicates,
    "sharding": sharding,
}

KEYED = f"k AS (SELECT *, {plain_sql('listed_key')} AS doc_key, CASE WHEN lower(trim(language)) IN ('english', 'eng', 'en') THEN 'ENGLISH' WHEN lower(trim(language)) IN ('sinhala', 'sin', 'si') THEN 'SINHALA' WHEN lower(trim(language)) IN ('tamil', 'tam', 'ta') THEN 'TAMIL' END AS label FROM listings)"
BEST = "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY coalesce(label, '~'), last_seen DESC, id DESC) AS n FROM k WHERE doc_key IS NOT NULL) WHERE n = 1)"
SNAPSHOTS = """o AS (SELECT doc_id, doc_key, CASE WHEN doc_id % 10 = 7 THEN 'elsewhere' ELSE source END AS source, sha256, lang, updated_at FROM documents WHERE updated_at < TIMESTAMP '2025-01-01'),
n AS (SELECT doc_id, doc_key, source, sha256, lang, updated_at FROM documents WHERE doc_id % 11 <> 0)"""

ORACLE: dict[str, str] = {
    "candidate_ranking": f"WITH {KEYED} SELECT doc_key, id, row_number() OVER (PARTITION BY doc_key ORDER BY CASE label WHEN 'ENGLISH' THEN 0 WHEN 'SINHALA' THEN 1 WHEN 'TAMIL' THEN 2 ELSE 3 END, s.trust NULLS LAST, last_seen DESC NULLS LAST, id DESC) AS place FROM k LEFT JOIN sources s USING (source) WHERE doc_key IS NOT NULL",
    "best_candidate_per_key": f"WITH {KEYED}, {BEST} SELECT doc_key, id, source, file_format FROM b",
    "choice_report": f"""WITH {KEYED}, {BEST}, h AS (SELECT doc_key, arg_max_null(listing_id, doc_id) AS held FROM documents GROUP BY doc_key)
SELECT CASE WHEN b.id IS NULL THEN 'only_held' WHEN held IS NULL THEN 'only_new' WHEN b.id = held THEN 'same' ELSE 'differs' END AS state, count(*) AS documents FROM h FULL OUTER JOIN b USING (doc_key) GROUP BY 1""",
    "changed_rows_cdc": f"WITH {SNAPSHOTS} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'gone' WHEN o.source IS DISTINCT FROM n.source THEN 'changed' ELSE 'same' END AS change FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id",
    "upsert_snapshot": f"WITH {SNAPSHOTS} SELECT doc_id, source, lang FROM n UNION ALL SELECT doc_id, source, lang FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)",
    "canonical_record": "SELECT id, md5('description=' || coalesce(json_extract_string(listing, '$.description'), '') || ';pages=' || coalesce(json_extract_string(listing, '$.pages'), '') || ';record=' || coalesce(json_extract_string(listing, '$.record'), '')) AS record FROM listings",
    "file_manifest": "SELECT sha256, string_agg(CAST(listing_id AS VARCHAR), ',' ORDER BY listing_id) AS listings, count(*) AS n FROM (SELECT DISTINCT sha256, listing_id FROM documents WHERE sha256 IS NOT NULL AND listing_id IS NOT NULL) GROUP BY sha256",
    "unshared_files": "SELECT DISTINCT sha256 FROM docs WHERE removed_at IS NOT NULL AND sha256 IS NOT NULL AND sha256 NOT IN (SELECT sha256 FROM docs WHERE removed_at IS NULL AND sha256 IS NOT NULL)",
    "run_snapshot": "SELECT source, count(*) AS rows, count(title) AS titles, max(id) AS last_id FROM listings GROUP BY source",
    "landed_listings": "SELECT source, count(*) AS rows, count(title) AS titles, 0 AS unread FROM listings GROUP BY source",
    "landed_of_source": "SELECT date, count(*) AS rows FROM listings WHERE source = 'state-press' GROUP BY date",
    "mirror_index": "SELECT source_url, arg_max(listed_key, id) AS listed_key, max(id) AS id FROM listings WHERE source = 'bundle-archive' AND source_url NOT IN (SELECT source_url FROM listings WHERE source <> 'bundle-archive' AND source_url IS NOT NULL) GROUP BY source_url",
    "json_paths": "SELECT id, CAST(listing->>'$.record' AS BIGINT) AS record, json_exists(listing, '$.pages') AS has_pages, CASE json_type(listing, '$.pages') WHEN 'UBIGINT' THEN 'number' WHEN 'VARCHAR' THEN 'text' END AS kind, '0' AS pages, len(list_filter(json_keys(listing), lambda k: k <> 'pages')) + 1 AS keys FROM listings",
    "listing_types": _types_sql.replace("regexp_like", "regexp_matches"),
    "is_law": _is_law_sql,
    "filter_all_words": _all_words_sql,
    "years_to_crawl": _years_sql.replace("explode(sequence(1990, 2026))", "unnest(range(1990, 2027))"),
    "backfill_todo": f"WITH {KEYED} SELECT doc_key, id FROM (SELECT doc_key, id, row_number() OVER (PARTITION BY doc_key ORDER BY last_seen DESC NULLS LAST, id) AS n FROM k WHERE doc_key IS NOT NULL AND doc_key NOT IN (SELECT {plain_sql('doc_key')} FROM documents WHERE doc_key IS NOT NULL)) WHERE n = 1",
    "same_file": "SELECT a.doc_id, min(b.doc_id) AS same_file FROM documents a JOIN documents b ON a.sha256 = b.sha256 AND b.doc_id < a.doc_id GROUP BY a.doc_id",
    "files_by_source": _shards_sql,
    "listed_again": _duplicates_sql,
    "sharding": "SELECT CAST('0x' || right(sha256, 8) AS BIGINT) % 16 AS shard, count(*) AS files FROM documents WHERE sha256 IS NOT NULL GROUP BY 1",
}
