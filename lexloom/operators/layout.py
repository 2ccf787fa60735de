"""Windows over lines, spans and levels: joined paragraphs, merged spans, nearest rows, common values, longest names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line) of every line with something on it."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).where(F.trim("line") != "")


def joined_paragraphs(rows: DataFrame, key: str, order: str, text: str, least: int = 60) -> DataFrame:
    """(key, first, lines, text): paragraphs that were cut in two, together again.

    A line goes on from the one before if that is at least so long and ends in a small letter or comma, and this begins with a
    letter and isn't all capitals or a row of a table: islands of lines by a running count of beginnings.
    """
    by = Window.partitionBy(key).orderBy(order)
    before = F.lag(text).over(by)
    goes_on = (F.length(before) >= least) & before.rlike("[a-z,]$") & F.col(text).rlike("^[A-Za-z]") & F.col(text).rlike("[a-z]") & ~F.col(text).contains("|")
    marked = rows.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = island.groupBy(key, "_island").agg(F.min(order).alias("first"), F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct(order, text))).alias("_t"))
    return joined.select(key, "first", "lines", F.array_join(F.transform("_t", lambda s: s[text]), " ").alias("text"))


def merged_spans(spans: DataFrame, key: str, start: str, end: str, gap: str = "0 seconds") -> DataFrame:
    """(key, start, end, spans): overlapping spans, and those nearer than the gap, as one. Spans without both ends are left out."""
    whole = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    by = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = whole.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + F.expr(f"interval {gap}")), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("spans")).drop("_island")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, id_: str, within: str) -> DataFrame:
    """(left columns, near): the row of right with the same key that lies nearest in time and no farther than within.

    Times are cut into blocks as long as the reach, and each left row looks into its own and the two beside it: an equi-join.
    """
    seconds = F.unix_timestamp(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {within}"))
    block = lambda c: F.floor(F.unix_timestamp(c) / seconds)
    a = left.withColumn("_block", F.explode(F.array(*[block(F.col(at)) + i for i in (-1, 0, 1)])))
    b = right.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.col(id_).alias("_near"), block(F.col(at)).alias("_b"))
    distance = F.abs(F.unix_timestamp(at) - F.unix_timestamp("_at"))
    met = a.join(b, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_b"))).where(distance <= seconds)
    best = met.groupBy(*left.columns).agg(F.min(F.struct(distance.alias("d"), F.col("_near"))).alias("_m"))
    return best.select(*left.columns, F.col("_m._near").alias("near"))


def common_value(df: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """(key, value, reached): the value with most rows no farther than the tolerance, the smallest of equals."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("value")).agg(F.count("*").alias("_n"))
    reach = counted.withColumn("reached", F.expr(f"sum(_n) over (partition by `{key}` order by value range between {tolerance}D preceding and {tolerance}D following)"))
    best = reach.groupBy(key).agg(F.min(F.struct((-F.col("reached")).alias("r"), F.col("value"))).alias("_b"))
    return best.select(key, F.col("_b.value").alias("value"), (-F.col("_b.r")).alias("reached"))


def longest_name(phrases: DataFrame, key: str, words: str, names: DataFrame, most: int = 12) -> DataFrame:
    """(key, words, doc_key): the longest ending of a phrase, of at most so many words, that is a known name (name, doc_key).

    All endings are rows, met with the names by an equi-join, and the longest is an aggregate.
    """
    parts = F.split(F.lower(words), r"\s+")
    count = F.least(F.size(parts), F.lit(most))
    endings = phrases.select(key, words, F.explode(F.transform(F.sequence(F.lit(1), count), lambda n: F.array_join(F.slice(parts, -n, n), " "))).alias("name"))
    met = endings.distinct().join(names.select("name", "doc_key"), "name")
    return met.groupBy(key, words).agg(F.max_by("doc_key", F.length("name")).alias("doc_key"))


def page_kind(characters: Column, images: Column, odd: Column, least: int = 20) -> Column:
    """scan, digital or blank: a page with images whose text is short or of another's making is a scan."""
    scan = images & ((characters < least) | odd)
    return F.when(scan, "scan").when(characters >= least, "digital").otherwise("blank")


def trimmed_key(key: Column, most: int = 64, kept: int = 55) -> Column:
    """A key of bounded length: one that is longer ends in eight digits of its hash."""
    return F.when(F.length(key) <= most, key).otherwise(F.concat(F.regexp_replace(F.substring(key, 1, kept), "[-_ .]+$", ""), F.lit("-"), F.substring(F.sha1(key), 1, 8)))
