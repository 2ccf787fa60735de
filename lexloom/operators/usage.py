"""Reports over an append-only ledger of metered usage (id, at, user, kind, cost, quantities as JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.periods import home_day


def append_once(ledger: DataFrame, events: DataFrame, idem: str, order: str) -> DataFrame:
    """The ledger after events: an idempotency key is taken once, the ledger's before the first event's; null keys always."""
    keyed = events.where(F.col(idem).isNotNull()).join(ledger.where(F.col(idem).isNotNull()).select(idem), idem, "left_anti")
    rest = [c for c in ledger.columns if c != idem]
    first = keyed.groupBy(idem).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(idem, "_row.*")
    return ledger.unionByName(first.select(ledger.columns)).unionByName(events.where(F.col(idem).isNull()).select(ledger.columns))


def quantities(ledger: DataFrame, by: list[str], quantity: str) -> DataFrame:
    """(by, quantities): the sums of every key of the JSON map of quantities, put together as a map again."""
    long = ledger.select(*by, F.explode(F.from_json(quantity, "map<string,double>")).alias("_k", "_v")).groupBy(*by, "_k").agg(F.sum("_v").alias("_v"))
    return long.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("quantities"))


def daily(ledger: DataFrame, at: str, cost: str) -> DataFrame:
    """(day, events, cost) of each home day, with days between the first and the last that had none as zeros."""
    per = ledger.where(F.col(at).isNotNull()).groupBy(home_day(F.col(at)).alias("day")).agg(F.count("*").alias("events"), F.sum(cost).alias("cost"))
    # One row of limits makes the calendar, so its size is the number of days and not of events.
    days = per.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(per, "day", "left").select("day", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


def active_plan(users: DataFrame, grants: DataFrame, plans: DataFrame, at: str) -> DataFrame:
    """(user columns, plan): of the grants (user_id, plan, starts_at, ends_at) that hold at a time the one begun last, else the default plan.

    A grant holds from its start to before its end (null: open); one of an unknown plan counts for nothing.
    """
    known = grants.join(plans.select("plan"), "plan", "left_semi")
    held = users.join(known, "user_id").where((F.col("starts_at") <= F.col(at)) & (F.col("ends_at").isNull() | (F.col(at) < F.col("ends_at"))))
    last = held.groupBy(*users.columns).agg(F.max(F.struct("starts_at", "plan")).alias("_g")).select(*users.columns, F.col("_g.plan").alias("_plan"))
    default = plans.where("is_default").agg(F.min("plan").alias("_default"))
    return users.join(last, users.columns, "left").join(F.broadcast(default)).select(*users.columns, F.coalesce("_plan", "_default").alias("plan"))


def over_limit(used, most, adding=None):
    """Whether a counter is used up (no adding), or a cap would be passed; a null limit is none."""
    return F.coalesce((used >= most) if adding is None else (used + adding > most), F.lit(False))


def sessions(events: DataFrame, user: str, at: str, gap: str) -> DataFrame:
    """(user, session, start, end, events): runs of a user's events with less than the gap between neighbours."""
    order = Window.partitionBy(user).orderBy(at)
    fresh = F.when(F.lag(at).over(order).isNull() | (F.col(at) >= F.lag(at).over(order) + F.expr(f"interval {gap}")), 1).otherwise(0)
    numbered = events.select(user, at, fresh.alias("_f")).withColumn("session", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(user, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("events"))
