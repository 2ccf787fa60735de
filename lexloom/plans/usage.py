"""Reports over the events as a ledger: kind = event_type, cost = value, quantities = props, at = ts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.periods import home_day, home_month, within
from lexloom.operators import usage as u
from lexloom.plans.shared import both
from lexloom.tables import table

HALF = "2024-01-16 00:00:00"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("value", F.col("value").cast("decimal(18,10)"))


def _money(c):
    return F.round(F.coalesce(F.sum(c), F.lit(0)).cast("double"), 4)


def idempotent_append(spark: SparkSession, folder: str) -> DataFrame:
    """The first half of the events as the ledger; all events again, every seventh without a key."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "value", F.when(F.col("event_id") % 7 != 0, F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMddHH"))).alias("idem"))
    ledger = events.where(F.col("ts") < F.lit(HALF).cast("timestamp"))
    ledger = ledger.where("idem is not null").groupBy("idem").agg(F.min_by(F.struct("event_id", "ts", "user_id", "value"), "event_id").alias("r")).select("r.*", "idem").select(events.columns)
    return u.append_once(ledger, events, "idem", "event_id").select("event_id", "idem")


def usage_total(spark: SparkSession, folder: str) -> DataFrame:
    when = within(F.col("ts"), F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-25").cast("timestamp"))
    only = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    return _events(spark, folder).where(when).agg(
        F.count("*").alias("events"), _money("value").alias("cost"), _money(only("purchase")).alias("purchases"), _money(only("view")).alias("views"),
        F.count(only("click")).alias("clicks"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers"),
        F.bool_or(F.col("event_type") == "error").alias("errors"), F.max("ts").alias("last_at"))


def usage_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).groupBy("user_id").agg(F.count("*").alias("events"), _money("value").alias("cost"), F.max("ts").alias("last_at"))


def usage_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    totals = events.groupBy("event_type").agg(F.count("*").alias("events"), _money("value").alias("cost"))
    sums = u.quantities(events, ["event_type"], "props").select("event_type", F.explode("quantities").alias("quantity", "amount"))
    return totals.join(sums, "event_type", "left").select("event_type", "events", "cost", "quantity", F.round("amount", 4).alias("amount"))


def usage_daily(spark: SparkSession, folder: str) -> DataFrame:
    return u.daily(_events(spark, folder), "ts", "value").select("day", "events", F.round(F.col("cost").cast("double"), 4).alias("cost"))


def user_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and spend of each user on one home day and in its month."""
    day = F.lit("2024-01-15").cast("date")
    today = home_day(F.col("ts")) == day
    return _events(spark, folder).where(home_month(F.col("ts")) == F.trunc(day, "MM")).groupBy("user_id").agg(
        F.count(F.when(today & (F.col("event_type") == "view"), 1)).alias("views_today"), _money(F.when(today, F.col("value"))).alias("spend_today"), _money("value").alias("spend_month"))


def period_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Cost and events of each kind in a period beside those of the one before."""
    ts, at = F.col("ts"), lambda t: F.lit(t).cast("timestamp")
    now, before = within(ts, at("2024-01-11"), at("2024-01-21")), within(ts, at("2024-01-01"), at("2024-01-11"))
    return _events(spark, folder).groupBy("event_type").agg(F.count(F.when(now, 1)).alias("events"), F.count(F.when(before, 1)).alias("events_before"), _money(F.when(now, F.col("value"))).alias("cost"), _money(F.when(before, F.col("value"))).alias("cost_before"))


def _plans(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    plans = spark.sql("SELECT * FROM VALUES ('basic', true, 5.0D), ('team', false, 50.0D), ('firm', false, CAST(NULL AS DOUBLE)) AS t(plan, is_default, most)")
    return plans, spark.sql("SELECT id % 97 AS user_id, CASE id % 4 WHEN 0 THEN 'team' WHEN 1 THEN 'firm' WHEN 2 THEN 'gone' ELSE 'basic' END AS plan, make_timestamp(2024, 1, CAST(1 + id % 20 AS INT), 0, 0, 0) AS starts_at, CASE WHEN id % 3 = 0 THEN make_timestamp(2024, 1, CAST(8 + id % 20 AS INT), 0, 0, 0) END AS ends_at FROM range(150)")


def plan_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The plan of each event's user at its time, and whether the user's spend of the day is used up by it."""
    plans, grants = _plans(spark)
    asked = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return u.active_plan(asked, grants, plans, "ts").select("event_id", "plan")


def limits_reached(spark: SparkSession, folder: str) -> DataFrame:
    plans, grants = _plans(spark)
    spent = _events(spark, folder).groupBy("user_id", home_day(F.col("ts")).alias("day")).agg(F.round(F.sum("value").cast("double"), 4).alias("used"), F.max("ts").alias("at"))
    with_plan = u.active_plan(spent, grants, plans, "at").join(F.broadcast(plans.select("plan", "most")), "plan")
    return with_plan.select("user_id", "day", "plan", "used", u.over_limit(F.col("used"), F.col("most")).alias("reached"))


def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return u.sessions(table(spark, folder, "events").where("ts is not null"), "user_id", "ts", "6 hours").select("user_id", "session", "start", "end", "events")


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Each nation with its customers and suppliers, counted apart: a join of both holds every customer with every supplier of the nation."""
    customers = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("customers"), F.max("c_acctbal").alias("best"), F.min("c_mktsegment").alias("first"), F.max("c_mktsegment").alias("last"))
    suppliers = table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.count_distinct("s_suppkey").alias("suppliers"))
    nations = table(spark, folder, "nation").select("n_name", "n_nationkey").distinct()
    joined = nations.join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return joined.select(
        "n_name", "n_nationkey", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.round("best", 2).alias("best"),
        F.when(F.col("first") < F.col("last"), F.col("last")).otherwise("one").alias("segment"))


_recon, _recon_sql = both("""
WITH a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS ours FROM {events} WHERE event_type <> 'error' GROUP BY CAST(ts AS DATE)),
b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS theirs FROM {events} WHERE event_id % 10 <> 0 GROUP BY CAST(ts AS DATE))
SELECT coalesce(a.day, b.day) AS day, coalesce(ours, 0) AS ours, coalesce(theirs, 0) AS theirs, coalesce(ours, 0) - coalesce(theirs, 0) AS difference FROM a FULL OUTER JOIN b ON a.day = b.day
""")
_, _members_sql = both("""
SELECT n.n_name, n.n_nationkey, count(DISTINCT c.c_custkey) AS customers, count(DISTINCT s.s_suppkey) AS suppliers, round(max(c.c_acctbal), 2) AS best,
  CASE WHEN min(c.c_mktsegment) < max(c.c_mktsegment) THEN max(c.c_mktsegment) ELSE 'one' END AS segment
FROM {nation} n LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey LEFT JOIN {supplier} s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name, n.n_nationkey
""")
_unattributed, _unattributed_sql = both("""
SELECT e.event_type, count(*) AS events FROM {events} e WHERE e.user_id IS NULL OR NOT EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_suppkey = e.user_id) GROUP BY e.event_type
""")
_top_spenders, _top_spenders_sql = both("""
SELECT user_id, round(sum(value), 3) AS cost, max(ts) AS last_at FROM {events} WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY round(sum(value), 3) DESC, max(ts) DESC, user_id LIMIT 5
""")
_orders_spend, _orders_spend_sql = both("""
SELECT o.o_custkey, count(*) AS orders, count(DISTINCT l.l_partkey) AS parts, max(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AS returned, CAST(sum(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey
""")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "idempotent_append": idempotent_append,
    "usage_total": usage_total,
    "usage_by_user": usage_by_user,
    "usage_breakdown": usage_breakdown,
    "usage_daily": usage_daily,
    "user_counters": user_counters,
    "period_compare": period_compare,
    "plan_as_of": plan_as_of,
    "limits_reached": limits_reached,
    "user_sessions": user_sessions,
    "reconciliation": _recon,
    "members": members,
    "unattributed": _unattributed,
    "top_spenders": _top_spenders,
    "spend_by_customer": _orders_spend,
}

DAY = "CAST(ts + INTERVAL 330 MINUTE AS DATE)"
GRANTS = """plans AS (SELECT * FROM (VALUES ('basic', true, 5.0::DOUBLE), ('team', false, 50.0::DOUBLE), ('firm', false, NULL::DOUBLE)) t(plan, is_default, most)),
grants AS (SELECT id % 97 AS user_id, CASE id % 4 WHEN 0 THEN 'team' WHEN 1 THEN 'firm' WHEN 2 THEN 'gone' ELSE 'basic' END AS plan, make_timestamp(2024, 1, 1 + id % 20, 0, 0, 0) AS starts_at, CASE WHEN id % 3 = 0 THEN make_timestamp(2024, 1, 8 + id % 20, 0, 0, 0) END AS ends_at FROM range(150) t(id))"""

ORACLE: dict[str, str] = {
    "idempotent_append": f"""
WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 7 <> 0 THEN concat_ws('-', user_id, strftime(ts, '%Y%m%d%H')) END AS idem FROM events),
led AS (SELECT idem, min(event_id) AS event_id FROM e WHERE ts < TIMESTAMP '{HALF}' AND idem IS NOT NULL GROUP BY idem)
SELECT event_id, idem FROM led UNION ALL SELECT min(event_id), idem FROM e WHERE idem IS NOT NULL AND idem NOT IN (SELECT idem FROM led) GROUP BY idem UNION ALL SELECT event_id, idem FROM e WHERE idem IS NULL""",
    "usage_total": """
SELECT count(*) AS events, round(sum(value::DECIMAL(18,10))::DOUBLE, 4) AS cost, round(coalesce(sum(value::DECIMAL(18,10)) FILTER (WHERE event_type = 'purchase'), 0)::DOUBLE, 4) AS purchases,
  round(coalesce(sum(value::DECIMAL(18,10)) FILTER (WHERE event_type = 'view'), 0)::DOUBLE, 4) AS views, count(value) FILTER (WHERE event_type = 'click') AS clicks, count(DISTINCT user_id) AS users,
  count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS buyers, bool_or(event_type = 'error') AS errors, max(ts) AS last_at
FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'""",
    "usage_by_user": "SELECT user_id, count(*) AS events, round(coalesce(sum(value::DECIMAL(18,10)), 0)::DOUBLE, 4) AS cost, max(ts) AS last_at FROM events GROUP BY user_id",
    "usage_breakdown": """
WITH t AS (SELECT event_type, count(*) AS events, round(coalesce(sum(value::DECIMAL(18,10)), 0)::DOUBLE, 4) AS cost FROM events GROUP BY event_type),
q AS (SELECT event_type, k AS quantity, round(sum(CAST(json_extract_string(props, '$.' || k) AS DOUBLE)), 4) AS amount FROM (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events) GROUP BY event_type, k)
SELECT event_type, events, cost, quantity, amount FROM t LEFT JOIN q USING (event_type)""",
    "usage_daily": f"""
WITH p AS (SELECT {DAY} AS day, count(*) AS events, round(sum(value::DECIMAL(18,10))::DOUBLE, 4) AS cost FROM events WHERE ts IS NOT NULL GROUP BY 1),
d AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM p)
SELECT d.day, coalesce(events, 0) AS events, coalesce(cost, 0.0) AS cost FROM d LEFT JOIN p USING (day)""",
    "user_counters": f"""
SELECT user_id, count(*) FILTER (WHERE {DAY} = DATE '2024-01-15' AND event_type = 'view') AS views_today, round(coalesce(sum(value::DECIMAL(18,10)) FILTER (WHERE {DAY} = DATE '2024-01-15'), 0)::DOUBLE, 4) AS spend_today,
  round(coalesce(sum(value::DECIMAL(18,10)), 0)::DOUBLE, 4) AS spend_month FROM events WHERE date_trunc('month', {DAY}) = DATE '2024-01-01' GROUP BY user_id""",
    "period_compare": """
SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21') AS events, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-11') AS events_before,
  round(coalesce(sum(value::DECIMAL(18,10)) FILTER (WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21'), 0)::DOUBLE, 4) AS cost,
  round(coalesce(sum(value::DECIMAL(18,10)) FILTER (WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-11'), 0)::DOUBLE, 4) AS cost_before FROM events GROUP BY event_type""",
    "plan_as_of": f"""
WITH {GRANTS}, h AS (SELECT e.event_id, g.plan, row_number() OVER (PARTITION BY e.event_id ORDER BY g.starts_at DESC, g.plan DESC) AS n FROM events e JOIN grants g ON g.user_id = e.user_id AND g.starts_at <= e.ts AND (g.ends_at IS NULL OR e.ts < g.ends_at)
  WHERE g.plan IN (SELECT plan FROM plans))
SELECT e.event_id, coalesce(h.plan, 'basic') AS plan FROM events e LEFT JOIN h ON h.event_id = e.event_id AND h.n = 1""",
    "limits_reached": f"""
WITH {GRANTS}, s AS (SELECT user_id, {DAY} AS day, round(sum(value::DECIMAL(18,10))::DOUBLE, 4) AS used, max(ts) AS at FROM events GROUP BY 1, 2),
h AS (SELECT s.user_id, s.day, g.plan, row_number() OVER (PARTITION BY s.user_id, s.day ORDER BY g.starts_at DESC, g.plan DESC) AS n FROM s JOIN grants g ON g.user_id = s.user_id AND g.starts_at <= s.at AND (g.ends_at IS NULL OR s.at < g.ends_at) WHERE g.plan IN (SELECT plan FROM plans))
SELECT s.user_id, s.day, p.plan, s.used, coalesce(s.used >= p.most, false) AS reached FROM s LEFT JOIN h ON h.user_id IS NOT DISTINCT FROM s.user_id AND h.day = s.day AND h.n = 1 JOIN plans p ON p.plan = coalesce(h.plan, 'basic')""",
    "user_sessions": """
WITH f AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, session, min(ts) AS start, max(ts) AS "end", count(*) AS events FROM s GROUP BY user_id, session""",
    "reconciliation": _recon_sql,
    "members": _members_sql,
    "unattributed": _unattributed_sql,
    "top_spenders": _top_spenders_sql,
    "spend_by_customer": _orders_spend_sql,
}
