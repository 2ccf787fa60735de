"""Cases as documents of items: their log replayed, diaries, versions, states of files, cards, accounts, and what users may spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations of a case's log by what they do to an item: make it, set one of its fields, clear one, or take it away.
MAKES, SETS, CLEARS, REMOVES = "make", "set", "clear", "remove"


def replayed(log: DataFrame, case: str, item: str, does: str, name: str, value: str, order: list[str]) -> DataFrame:
    """(case, item, fields): the items that a case has after all operations of its log, each with its fields.

    An operation on an item makes it, sets or clears a field, or removes it. Of each field the last operation holds, and only
    those since the item was last removed; an item exists if anything came after that. Two aggregates, whatever the log's length.
    """
    at = F.struct(*order)
    gone = log.where(F.col(does) == REMOVES).groupBy(case, item).agg(F.max(at).alias("_gone"))
    alive = log.where(F.col(does) != REMOVES).join(gone, [case, item], "left").where(F.col("_gone").isNull() | (at > F.col("_gone")))
    last = alive.groupBy(case, item, name).agg(F.max_by(F.struct(F.col(does).alias("does"), F.col(value).cast("string").alias("value")), at).alias("_last"))
    field = F.when((F.col("_last.does") == SETS) & F.col(name).isNotNull(), F.struct(F.col(name).alias("key"), F.col("_last.value").alias("value")))
    fields = F.array_sort(F.collect_list(field))
    return last.groupBy(case, item).agg(F.map_from_entries(fields).alias("fields"))


def diary(items: DataFrame, case: str, due: str, done: Column, now: Column) -> DataFrame:
    """(case, next_date, upcoming, awaiting, overdue): of each case the next date, how many lie ahead, how many are past without an outcome, and the days since the first of those."""
    ahead, past = F.col(due) >= now, (F.col(due) < now) & ~done
    first = F.min(F.when(past, F.col(due)))
    return items.groupBy(case).agg(F.min(F.when(ahead, F.col(due))).alias("next_date"), F.count(F.when(ahead, 1)).alias("upcoming"), F.count(F.when(past, 1)).alias("awaiting"), F.coalesce(F.datediff(now, first), F.lit(0)).alias("overdue"))


def open_tasks(items: DataFrame, case: str, item: str, due: str, done: Column, most: int) -> DataFrame:
    """(case, tasks): the open tasks of each case that are due first, those without a date last."""
    place = F.struct(F.col(due).isNull().alias("undated"), F.col(due).alias("due"), F.col(item).cast("string").alias("item"))
    rows = items.where(~done).groupBy(case).agg(F.array_sort(F.collect_list(place)).alias("t"))
    return rows.select(case, F.array_join(F.transform(F.slice("t", 1, most), lambda t: t["item"]), ",").alias("tasks"))


def versioned_writes(current: DataFrame, writes: DataFrame, key: str, base: str, order: str) -> DataFrame:
    """(key, order, accepted): which writes hold: the first of those that know the present version; the others must read it again.

    current has (key, version); a key that it lacks is at version 0. A null base knows nothing.
    """
    known = writes.join(current.select(key, "version"), key, "left")
    fits = F.col(base) == F.coalesce("version", F.lit(0))
    first = known.where(fits).groupBy(key).agg(F.min(order).alias("_first"))
    return known.join(first, key, "left").select(key, order, F.coalesce(fits & (F.col(order) == F.col("_first")), F.lit(False)).alias("accepted"))


def claims(events: DataFrame, key: str, at: str, ends: Column, now: Column, stale: str = "15 minutes") -> DataFrame:
    """(key, state): `done` if the last event ended the work, `busy` if it is younger than a stale claim, else `free` to be claimed again."""
    last = events.where(F.col(at).isNotNull()).groupBy(key).agg(F.max_by(F.struct(F.col(at).alias("at"), ends.alias("ended")), F.struct(F.col(at), ends)).alias("l"))
    return last.select(key, F.when(F.col("l.ended"), "done").when(F.col("l.at") > now - F.expr(f"interval {stale}"), "busy").otherwise("free").alias("state"))


def file_state(read: Column, described: Column, searched: Column) -> Column:
    """A file's state as a user sees it, from the states of its three steps."""
    steps = [read, described, searched]
    any_of = lambda state: F.coalesce(steps[0] == state, F.lit(False)) | F.coalesce(steps[1] == state, F.lit(False)) | F.coalesce(steps[2] == state, F.lit(False))
    return F.when(F.coalesce(read == "failed", F.lit(False)), "unreadable").when(any_of("busy"), "working").when(any_of("failed"), "partly").when(F.coalesce((read == "done") & (described == "done") & (searched == "done"), F.lit(False)), "ready").otherwise("waiting")


def patched(card: Column, patch: Column, edited: Column) -> Column:
    """A card (map) with a patch laid over it, but for the fields that a person has edited; their keys in order."""
    laid = F.map_zip_with(card, patch, lambda k, x, y: F.when(F.array_contains(edited, k), x).otherwise(F.coalesce(y, x)))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(laid, lambda k, v: v.isNotNull()))))


def accounts(held: DataFrame, seen: DataFrame, external: str, fields: list[str]) -> DataFrame:
    """(external, fields, is_new): accounts after those seen are upserted by their id elsewhere; a field seen as null keeps what is held."""
    a = held.select(external, *[F.col(f).alias(f"_h_{f}") for f in fields], F.lit(True).alias("_held"))
    b = seen.groupBy(external).agg(*[F.max(f).alias(f"_s_{f}") for f in fields])
    met = a.join(b, external, "full_outer")
    return met.select(external, *[F.coalesce(f"_s_{f}", f"_h_{f}").alias(f) for f in fields], F.col("_held").isNull().alias("is_new"))


def effective_limits(users: DataFrame, own: DataFrame, plans: DataFrame, metrics: list[str], now: Column) -> DataFrame:
    """(user_id, metric, most, own): what each user may use of each metric; null is without limit.

    own has (user_id, metric, most, expires_at) and goes before the plan's (plan, metric, most) while it hasn't expired, its null
    too; of several rows the one that expires last counts.
    """
    live = own.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    last = live.groupBy("user_id", "metric").agg(F.max(F.struct(F.col("expires_at").isNull().alias("forever"), F.col("expires_at").alias("e"), F.col("most").isNull().alias("free"), F.col("most").alias("most"))).alias("_own"))
    wide = users.select("user_id", "plan", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    planned = wide.join(plans, ["plan", "metric"], "left").join(last, ["user_id", "metric"], "left")
    return planned.select("user_id", "metric", F.when(F.col("_own").isNotNull(), F.col("_own.most")).otherwise(F.col("most")).alias("most"), F.col("_own").isNotNull().alias("own"))


def share_used(used: Column, most: Column) -> Column:
    """How much of an allowance is used, in whole per cent, 100 at most; null without a limit, so that no sum of money shows."""
    return F.when(most.isNull(), None).when(most <= 0, F.lit(100)).otherwise(F.least(F.lit(100), F.floor(used / most * 100))).cast("int")


def spend_by_ref(events: DataFrame, things: DataFrame, ref: Column, id_: str, kind: str, cost: str, most: int = 50) -> DataFrame:
    """(id, events, cost, kinds, errors) of the things that cost most, by the id in the events' reference; what no thing has is left out."""
    spent = events.withColumn("_id", ref).where("_id is not null").groupBy("_id").agg(F.count("*").alias("events"), F.round(F.sum(F.col(cost).cast("decimal(18,10)")).cast("double"), 4).alias("cost"), F.count_distinct(kind).alias("kinds"), F.bool_or(F.col(kind) == "error").alias("errors"))
    return things.select(F.col(id_).alias("id")).join(spent, F.col("id") == F.col("_id")).drop("_id").orderBy(F.desc("cost"), "id").limit(most)
