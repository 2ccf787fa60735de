"""Case documents as JSON: item-level differences, diaries, logs of operations, states of files, windows of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def item_diff(before: DataFrame, after: DataFrame, key: str, items: str) -> DataFrame:
    """(key, item, change) between two versions of documents whose column items is a map from item id to its JSON."""
    a = before.select(key, F.explode(items).alias("item", "_a"))
    b = after.select(key, F.explode(items).alias("item", "_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, [key, "item"], "full_outer").select(key, "item", change.alias("change")).where("change is not null")


def replay(log: DataFrame, case: str, item: str, op: str, order: list[str]) -> DataFrame:
    """(case, items, removed, version): the state of each case after its operations `add`, `set` and `remove`, the last of an item holding."""
    last = log.groupBy(case, item).agg(F.max_by(op, F.struct(*order)).alias("last"), F.count("*").alias("n"))
    return last.groupBy(case).agg(F.count(F.when(F.col("last") != "remove", 1)).alias("items"), F.count(F.when(F.col("last") == "remove", 1)).alias("removed"), F.sum("n").alias("version"))


def file_states(log: DataFrame, file: str, step: str, state: str, at: str) -> DataFrame:
    """(file, step, state, at): the newest state of each step; a late report never turns a state back."""
    return log.where(F.col(at).isNotNull()).groupBy(file, step).agg(F.max(F.struct(F.col(at).alias("_at"), F.col(state).alias("_state"))).alias("_m")).select(file, step, F.col("_m._state").alias(state), F.col("_m._at").alias(at))


def read_window(pages: DataFrame, key: str, order: list[str], text: str, most_rows: int, most_characters: int) -> DataFrame:
    """The first rows of each key within both bounds (`shown`), and whether more follow; the first row is always shown."""
    window = Window.partitionBy(key).orderBy(*order)
    running = F.sum(F.length(text)).over(window.rowsBetween(Window.unboundedPreceding, 0))
    marked = pages.select(key, F.row_number().over(window).alias("_n"), running.alias("_sum"))
    fits = (F.col("_n") == 1) | ((F.col("_n") <= most_rows) & (F.col("_sum") <= most_characters))
    return marked.groupBy(key).agg(F.count(F.when(fits, 1)).alias("shown"), (F.count("*") > F.count(F.when(fits, 1))).alias("more"))


def handles(df: DataFrame, group: str, item: str, order: list[str]) -> DataFrame:
    """(group, item, handle): dense numbers from 1 in the order in which a group's items are first seen."""
    first = df.where(F.col(item).isNotNull()).groupBy(group, item).agg(F.min(F.struct(*order)).alias("_first"))
    return first.select(group, item, F.row_number().over(Window.partitionBy(group).orderBy("_first")).alias("handle"))
