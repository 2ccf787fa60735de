"""Queries of cases, accounts and allowances. Orders stand for cases, their lines for items, events for the log of operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import cases as c
from lexloom.operators.best import first_rows
from lexloom.tables import table

NOW = "1999-06-01"
MOMENT = "2024-01-20 12:00:00"


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as operations: a signup makes an item, a view sets its note, a purchase its price, a click clears the note, an error removes it."""
    events = table(spark, folder, "events").where("user_id is not null and ts is not null")
    does = F.when(F.col("event_type") == "signup", c.MAKES).when(F.col("event_type") == "error", c.REMOVES).when(F.col("event_type") == "click", c.CLEARS).otherwise(c.SETS)
    name = F.when(F.col("event_type").isin("view", "click"), "note").when(F.col("event_type") == "purchase", "price")
    return events.select(F.col("user_id").alias("case"), F.get_json_object("props", "$.k").cast("int").alias("item"), does.alias("does"), name.alias("name"), F.col("event_id").alias("value"), "ts", "event_id")


def case_items(spark: SparkSession, folder: str) -> DataFrame:
    out = c.replayed(_log(spark, folder), "case", "item", "does", "name", "value", ["ts", "event_id"])
    return out.select("case", "item", F.to_json("fields").alias("fields"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("due"), (F.col("l_linestatus") == "F").alias("done"))


def case_diary(spark: SparkSession, folder: str) -> DataFrame:
    return c.diary(_lines(spark, folder), "l_orderkey", "due", F.col("done"), F.lit(NOW).cast("date"))


def case_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return c.open_tasks(_lines(spark, folder), "l_orderkey", "l_linenumber", "due", F.col("done"), 3)


def versioned_writes(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of an order as writes that know the version before theirs, against orders at the version of their status."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("version"))
    writes = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 3).alias("base"), F.col("l_linenumber").alias("n")).distinct()
    return c.versioned_writes(orders, writes, "k", "base", "n")


def claim_states(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").where(F.col("ts") < F.lit(MOMENT).cast("timestamp"))
    return c.claims(events, "user_id", "ts", F.col("event_type") == "purchase", F.lit(MOMENT).cast("timestamp"), "6 hours")


def file_views(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as files whose steps are read, described and searched, grouped by the state that a user sees, those at work first."""
    orders = table(spark, folder, "orders")
    read = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderkey") % 13 == 0, "failed").otherwise("busy")
    described = F.when(F.col("o_orderpriority").startswith("1"), "failed").when(F.col("o_orderstatus") == "F", "done")
    searched = F.when(F.col("o_totalprice") > 100000, "done")
    state = c.file_state(read, described, searched)
    order = F.element_at(F.create_map(*[F.lit(x) for kv in {"working": 1, "waiting": 2, "partly": 3, "unreadable": 4, "ready": 5}.items() for x in kv]), F.col("state"))
    return orders.select("o_orderkey", state.alias("state")).groupBy("state").agg(F.count("*").alias("files"), F.min("o_orderkey").alias("first")).withColumn("place", order)


def card_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Cards of customers patched by those of suppliers with their number; who has a negative balance has edited the segment."""
    customers = table(spark, folder, "customer").select("c_custkey", F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("card"), F.when(F.col("c_acctbal") < 0, F.array(F.lit("segment"))).otherwise(F.array().cast("array<string>")).alias("edited"))
    patches = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.create_map(F.lit("segment"), F.lit("PATCHED"), F.lit("supplier"), F.col("s_name")).alias("patch"))
    return customers.join(patches, "c_custkey").select("c_custkey", F.to_json(c.patched(F.col("card"), F.col("patch"), F.col("edited"))).alias("card"))


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Customers held, and seen again with orders: the segment stays, the last price comes."""
    held = table(spark, folder, "customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("segment"), F.lit(None).cast("double").alias("price")).where("user % 2 = 0")
    seen = table(spark, folder, "orders").select(F.col("o_custkey").alias("user"), F.lit(None).cast("string").alias("segment"), F.col("o_totalprice").alias("price"))
    return c.accounts(held, seen, "user", ["segment", "price"])


def last_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The last three messages of each chat, by time and number."""
    rows = table(spark, folder, "events").where("user_id is not null").select("user_id", "event_id", "ts")
    return first_rows(rows, ["user_id"], [F.desc_nulls_last("ts"), F.desc("event_id")], 3).select("user_id", "rank", "event_id")


PLANS = "SELECT * FROM VALUES ('BUILDING', 'orders', CAST(12 AS DOUBLE)), ('BUILDING', 'spend', CAST(2000000 AS DOUBLE)), ('MACHINERY', 'orders', CAST(20 AS DOUBLE)), ('FURNITURE', 'spend', CAST(0 AS DOUBLE)) AS t(plan, metric, most)"


def allowances(spark: SparkSession, folder: str) -> DataFrame:
    """What each customer has used of each allowance: the plan is the segment, an urgent order of the last year a limit of one's own, one in progress lifts it."""
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("plan"))
    orders = table(spark, folder, "orders")
    own = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id"), F.lit("spend").alias("metric"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") * 10).alias("most"), F.date_add(F.col("o_orderdate").cast("date"), 365).alias("expires_at"))
    limits = c.effective_limits(users, own, spark.sql(PLANS), ["orders", "spend"], F.lit(NOW).cast("date"))
    used = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").cast("double").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double").alias("spend"))
    met = limits.join(used, "user_id", "left").withColumn("used", F.coalesce(F.when(F.col("metric") == "orders", F.col("orders")).otherwise(F.col("spend")), F.lit(0.0)))
    return met.select("user_id", "metric", "own", F.col("most").isNull().alias("free"), c.share_used(F.col("used"), F.col("most")).alias("share"))


def spend_by_part(spark: SparkSession, folder: str) -> DataFrame:
    ref = F.get_json_object("props", "$.k").cast("long")
    return c.spend_by_ref(table(spark, folder, "events"), table(spark, folder, "part"), ref, "p_partkey", "event_type", "value")


def members_as_json(spark: SparkSession, folder: str) -> DataFrame:
    """Each nation with its suppliers as JSON in their order, five at most, and how many there are."""
    suppliers = table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"), F.slice(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))), 1, 5).alias("m"))
    return table(spark, folder, "nation").join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce(F.to_json("m"), F.lit("[]")).alias("members"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (case_items, case_diary, case_tasks, versioned_writes, claim_states, file_views, card_merge, accounts, last_messages, allowances, spend_by_part, members_as_json)}

ORACLE: dict[str, str] = {
    "case_items": """
WITH l AS (SELECT user_id AS "case", CAST(props->>'$.k' AS INT) AS item, event_type, event_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'note' WHEN event_type = 'purchase' THEN 'price' END AS name FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, max(CASE WHEN event_type = 'error' THEN (ts, event_id) END) OVER (PARTITION BY "case", item) AS gone FROM l),
a AS (SELECT *, row_number() OVER (PARTITION BY "case", item, name ORDER BY ts DESC, event_id DESC) AS n FROM g WHERE event_type <> 'error' AND (gone IS NULL OR (ts, event_id) > gone)),
f AS (SELECT "case", item, max(CASE WHEN event_type = 'view' THEN event_id END) AS note, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS price FROM a WHERE n = 1 GROUP BY ALL)
SELECT "case", item, '{' || concat_ws(',', '"note":"' || note || '"', '"price":"' || price || '"') || '}' AS fields FROM f""",
    "case_diary": f"""
WITH l AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS due, l_linestatus = 'F' AS done FROM lineitem)
SELECT l_orderkey, min(due) FILTER (WHERE due >= DATE '{NOW}') AS next_date, count(*) FILTER (WHERE due >= DATE '{NOW}') AS upcoming, count(*) FILTER (WHERE due < DATE '{NOW}' AND NOT done) AS awaiting, coalesce(DATE '{NOW}' - min(due) FILTER (WHERE due < DATE '{NOW}' AND NOT done), 0) AS overdue FROM l GROUP BY l_orderkey""",
    "case_tasks": "WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_shipdate AS DATE) NULLS LAST, CAST(l_linenumber AS VARCHAR)) AS n FROM lineitem WHERE l_linestatus <> 'F') SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY n) AS tasks FROM l WHERE n <= 3 GROUP BY l_orderkey",
    "versioned_writes": """
WITH w AS (SELECT DISTINCT l_orderkey AS k, l_suppkey % 3 AS base, l_linenumber AS n FROM lineitem),
v AS (SELECT w.*, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS version FROM w LEFT JOIN orders ON o_orderkey = w.k)
SELECT k, n, coalesce(base = version AND n = min(CASE WHEN base = version THEN n END) OVER (PARTITION BY k), false) AS accepted FROM v""",
    "claim_states": f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type = 'purchase' DESC) AS n FROM events WHERE ts < TIMESTAMP '{MOMENT}')
SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'done' WHEN ts > TIMESTAMP '{MOMENT}' - INTERVAL 6 HOUR THEN 'busy' ELSE 'free' END AS state FROM e WHERE n = 1""",
    "file_views": """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'busy' END AS r, CASE WHEN o_orderpriority LIKE '1%' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'done' ELSE '' END AS d, CASE WHEN o_totalprice > 100000 THEN 'done' ELSE '' END AS x FROM orders),
t AS (SELECT o_orderkey, CASE WHEN r = 'failed' THEN 'unreadable' WHEN 'busy' IN (r, d, x) THEN 'working' WHEN 'failed' IN (r, d, x) THEN 'partly' WHEN r = 'done' AND d = 'done' AND x = 'done' THEN 'ready' ELSE 'waiting' END AS state FROM s)
SELECT state, count(*) AS files, min(o_orderkey) AS first, CASE state WHEN 'working' THEN 1 WHEN 'waiting' THEN 2 WHEN 'partly' THEN 3 WHEN 'unreadable' THEN 4 ELSE 5 END AS place FROM t GROUP BY state""",
    "card_merge": """SELECT c_custkey, '{"name":"' || c_name || '","segment":"' || CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE 'PATCHED' END || '","supplier":"' || s_name || '"}' AS card FROM customer JOIN supplier ON s_suppkey = c_custkey""",
    "accounts": """
WITH h AS (SELECT c_custkey AS u, c_mktsegment AS segment FROM customer WHERE c_custkey % 2 = 0), s AS (SELECT o_custkey AS u, max(o_totalprice) AS price FROM orders GROUP BY o_custkey)
SELECT coalesce(h.u, s.u) AS "user", h.segment, s.price, h.u IS NULL AS is_new FROM h FULL OUTER JOIN s ON h.u = s.u""",
    "last_messages": "SELECT user_id, n AS rank, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS n FROM events WHERE user_id IS NOT NULL) WHERE n <= 3",
    "allowances": f"""
WITH p AS (SELECT * FROM (VALUES ('BUILDING', 'orders', 12.0::DOUBLE), ('BUILDING', 'spend', 2000000.0), ('MACHINERY', 'orders', 20.0), ('FURNITURE', 'spend', 0.0)) t(plan, metric, most)),
o AS (SELECT o_custkey AS user_id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 10 END AS most, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderstatus = 'P' DESC, o_totalprice DESC) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) + 365 > DATE '{NOW}'),
u AS (SELECT o_custkey AS user_id, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(15,2))) AS spend FROM orders GROUP BY o_custkey),
m AS (SELECT c.c_custkey AS user_id, k.metric, o.user_id IS NOT NULL AS own, CASE WHEN o.user_id IS NOT NULL THEN o.most ELSE p.most END AS most, CAST(coalesce(CASE WHEN k.metric = 'orders' THEN u.orders ELSE u.spend END, 0) AS DOUBLE) AS used
  FROM customer c CROSS JOIN (SELECT DISTINCT metric FROM p) k LEFT JOIN p ON p.plan = c.c_mktsegment AND p.metric = k.metric LEFT JOIN o ON o.user_id = c.c_custkey AND o.n = 1 AND k.metric = 'spend' LEFT JOIN u ON u.user_id = c.c_custkey)
SELECT user_id, metric, own, most IS NULL AS free, CAST(CASE WHEN most IS NULL THEN NULL WHEN most <= 0 THEN 100 ELSE least(100, floor(used / most * 100)) END AS INT) AS share FROM m""",
    "spend_by_part": """
WITH e AS (SELECT CAST(props->>'$.k' AS BIGINT) AS id, count(*) AS events, round(sum(value::DECIMAL(18,10))::DOUBLE, 4) AS cost, count(DISTINCT event_type) AS kinds, bool_or(event_type = 'error') AS errors FROM events GROUP BY 1)
SELECT e.* FROM e JOIN part ON p_partkey = e.id ORDER BY cost DESC, id LIMIT 50""",
    "members_as_json": """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n, count(*) OVER (PARTITION BY s_nationkey) AS total FROM supplier)
SELECT n_name, coalesce(max(total), 0) AS suppliers, '[' || coalesce(string_agg('{"id":' || s_suppkey || ',"name":"' || s_name || '"}', ',' ORDER BY n) FILTER (WHERE n <= 5), '') || ']' AS members FROM nation LEFT JOIN s ON s_nationkey = n_nationkey GROUP BY n_name""",
}
