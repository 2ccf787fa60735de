"""Queries of streams that keep snapshots and claims, of the release that is written, and of functions called from SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as t
from lexloom.functions.periods import before, period, whole_utc_days, within
from lexloom.operators import cdc, quality
from lexloom.streaming import ledger
from lexloom.tables import path_of, shared_folder, table

NOW = "2024-01-20 20:00:00"


def stream_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a user's events with less than fifteen minutes between them, of those that are closed."""
    events = ledger.table_stream(spark, folder, "events").where("user_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    return ledger.run_available(ledger.claims_of(events, "user_id", "ts", "15 minutes"), "claims", "append").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


def stream_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each user as a stream of events leaves it in a snapshot."""
    events = ledger.table_stream(spark, folder, "events").where("user_id is not null").select("user_id", "event_id", "event_type", "value")
    return ledger.keep_snapshot(events, "users", ["user_id"], ["event_id"])


def published_release(spark: SparkSession, folder: str) -> DataFrame:
    """A release written as a snapshot of its own, and read by what the pointer names: chunks a document."""
    chunks = table(spark, folder, "chunks")
    at = lambda day: chunks.where((F.col("built_at") <= F.lit(day).cast("timestamp")) & (F.col("removed_at").isNull() | (F.col("removed_at") > F.lit(day).cast("timestamp"))))
    old, new = at("2024-01-01"), at("2025-06-01")
    line = F.coalesce("text_hash", F.lit(""))
    was, now = cdc.fingerprint(old, ["doc_key"], line, ["seq", "id"]), cdc.fingerprint(new, ["doc_key"], line, ["seq", "id"])
    actions = quality.release(was, now, now.where(~F.col("doc_key").startswith("gazette:")))
    base = f"{shared_folder(spark)}/release-{uuid.uuid4().hex}"
    quality.published(old, new, actions).write.parquet(f"{base}/1")
    # Readers go by the pointer, which is written last: a release is there whole or not at all.
    spark.createDataFrame([(1,)], "current int").write.parquet(f"{base}/pointer")
    path_of(spark, base)[1].deleteOnExit(path_of(spark, base)[0])
    current = spark.read.parquet(f"{base}/pointer").first()[0]
    return spark.read.parquet(f"{base}/{current}").groupBy("doc_key").agg(F.count("*").alias("chunks"), F.max("built_at").alias("built_at"))


def sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Texts split by a table function, and lists of labels expanded, from SQL."""
    t.register(spark)
    rows = table(spark, folder, "chunks")
    return spark.sql("SELECT c.id, p.n, length(p.piece) AS characters, size(expand_labels(concat(c.label, ' to ', c.label))) AS labels FROM {rows} c, LATERAL pieces_of(c.text, 400) p WHERE length(c.text) <= 400", rows=rows)


def named_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each named period of the home zone and of the period before, and the whole UTC days that cover it."""
    events, now = table(spark, folder, "events"), F.lit(NOW).cast("timestamp")
    parts, ts = [], F.col("ts").cast("timestamp")
    for name in ("today", "yesterday", "this_month", "last_month"):
        start, end = period(name, now)
        first, last = whole_utc_days(start, end)
        count = lambda a, b: F.count(F.when(within(ts, a, b), 1))
        parts.append(events.agg(count(start, end).alias("events"), count(*before(start, end)).alias("before"), F.max(first).alias("first_day"), F.max(last).alias("after_day")).withColumn("period", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (stream_claims, stream_snapshot, published_release, sql_functions, named_periods)}

ORACLE: dict[str, str] = {
    "stream_claims": """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS f FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e),
s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 15 MINUTE AS "end", count(*) AS events FROM r GROUP BY user_id, run)
SELECT * FROM s WHERE "end" <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
    "stream_snapshot": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "published_release": """
WITH o AS (SELECT * FROM chunks WHERE built_at <= TIMESTAMP '2024-01-01' AND (removed_at IS NULL OR removed_at > TIMESTAMP '2024-01-01')), n AS (SELECT * FROM chunks WHERE built_at <= TIMESTAMP '2025-06-01' AND (removed_at IS NULL OR removed_at > TIMESTAMP '2025-06-01')),
a AS (SELECT doc_key, string_agg(coalesce(text_hash, ''), ',' ORDER BY seq, id) AS x FROM o GROUP BY 1), b AS (SELECT doc_key, string_agg(coalesce(text_hash, ''), ',' ORDER BY seq, id) AS y FROM n GROUP BY 1),
r AS (SELECT doc_key, x IS NOT DISTINCT FROM y AS same, doc_key NOT LIKE 'gazette:%' AS passed FROM b LEFT JOIN a USING (doc_key)),
p AS (SELECT n.* FROM n JOIN r USING (doc_key) WHERE NOT same AND passed UNION ALL SELECT o.* FROM o JOIN r USING (doc_key) WHERE same OR NOT passed)
SELECT doc_key, count(*) AS chunks, max(built_at) AS built_at FROM p GROUP BY doc_key""",
    "sql_functions": r"SELECT id, 1 AS n, length(text) AS characters, CASE WHEN label IS NULL THEN NULL WHEN regexp_matches(label, '^\d+[A-Z]?$') THEN 1 ELSE 0 END AS labels FROM chunks WHERE length(text) <= 400 AND text <> ''",
    "named_periods": """
WITH p AS (SELECT * FROM (VALUES ('today', TIMESTAMP '2024-01-20 18:30:00', TIMESTAMP '2024-01-21 18:30:00'), ('yesterday', TIMESTAMP '2024-01-19 18:30:00', TIMESTAMP '2024-01-20 18:30:00'),
  ('this_month', TIMESTAMP '2023-12-31 18:30:00', TIMESTAMP '2024-01-31 18:30:00'), ('last_month', TIMESTAMP '2023-11-30 18:30:00', TIMESTAMP '2023-12-31 18:30:00')) t(period, a, b))
SELECT period, (SELECT count(*) FROM events WHERE ts >= a AND ts < b) AS events, (SELECT count(*) FROM events WHERE ts >= a - (b - a) AND ts < a) AS before, CAST(a AS DATE) AS first_day, CAST(b AS DATE) + 1 AS after_day FROM p""",
}
