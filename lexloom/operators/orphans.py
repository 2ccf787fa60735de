"""References to records that do not exist: parent keys as runs of integers, references met as of the run before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.keys import plain_key, plain_label
from lexloom.operators.skew import HOT_ROWS, spread_join
from lexloom.tables import cut

#: Runs end at multiples of this, so that no window partition holds more distinct integers.
BLOCK = 4096
#: First part, integer without leading zeros, rest; the rest may hold a year after the integer.
SPLIT = r"^(.*?)([1-9][0-9]{0,14})([^0-9]+[0-9]{4}|[^0-9]*)$"
HEX_ID = r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def family_and_number(key: Column) -> tuple[Column, Column]:
    """A key as (family, integer); the two together determine the key, so equal pairs are equal keys.

    `act:9/2023` is 9 of the family `act:`+`/2023`; the last 12 digits of a UUID are a hexadecimal integer; a key without
    digits is 0 of the family of its own name.
    """
    parts = F.split(F.regexp_replace(key, SPLIT, "$1\u0001$2\u0001$3"), "\u0001")
    split = F.size(parts) == 3
    hexed = key.rlike(HEX_ID)
    family = F.when(hexed, F.concat(F.lit("\u0002"), F.substring(key, 1, 24))).when(split, F.concat(parts[0], F.lit("\u0001"), F.element_at(parts, 3))).otherwise(key)
    number = F.when(hexed, F.conv(F.substring(key, 25, 12), 16, 10).cast("long")).when(split, F.try_element_at(parts, F.lit(2)).cast("long")).otherwise(F.lit(0).cast("long"))
    return family, number


def keyed(df: DataFrame, key: str) -> DataFrame:
    family, number = family_and_number(F.col(key))
    return df.withColumn("family", family).withColumn("n", number).withColumn("block", F.floor(F.col("n") / BLOCK))


def runs(parents: DataFrame) -> DataFrame:
    """Distinct integer keys (field, family, block, n) as contiguous runs first..last."""
    group = ["field", "family", "block"]
    distinct = parents.select(*group, "n").distinct()
    island = F.col("n") - F.row_number().over(Window.partitionBy(*group).orderBy("n"))
    return distinct.withColumn("island", island).groupBy(*group, "island").agg(F.min("n").alias("first"), F.max("n").alias("last")).drop("island")


def beyond_runs(references: DataFrame, of: DataFrame) -> DataFrame:
    """Distinct references (field, family, block, n, ...) with `held`: whether the run that starts at or before n reaches n."""
    extra = [c for c in references.columns if c not in ("field", "family", "block", "n")]
    starts = of.select("field", "family", "block", F.col("first").alias("n"), *[F.lit(None).cast(references.schema[c].dataType).alias(c) for c in extra], F.lit(0).alias("side"), F.col("last"))
    asked = references.select("field", "family", "block", "n", *extra, F.lit(1).alias("side"), F.lit(None).cast("long").alias("last"))
    before = Window.partitionBy("field", "family", "block").orderBy("n", "side").rowsBetween(Window.unboundedPreceding, 0)
    return starts.unionByName(asked).withColumn("reach", F.last("last", ignorenulls=True).over(before)).where("side = 1").select("field", "family", "block", "n", *extra, F.coalesce(F.col("reach") >= F.col("n"), F.lit(False)).alias("held"))


def _merged(lives: DataFrame, key: list[str]) -> DataFrame:
    """Lives (key, from, to, newest) of each key as disjoint spans."""
    order = Window.partitionBy(*key).orderBy("from", "to")
    reach = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = lives.withColumn("new", F.when(reach.isNull() | (reach < F.col("from")), 1).otherwise(0)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*key, "island").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.max("newest").alias("newest")).drop("island")


def lifetimes(parents: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per key the disjoint spans of time in which some parent exists, and the latest time at which one is built.

    Overlapping lives are merged as runs of time; a removed_at of null is an open end, a life that ends before or when it
    begins covers nothing but still counts as built. A null built_at never exists. Keys with very many parents are merged month
    by month first, so that no task sorts all of their rows; how many there are is bounded by what makes them hot.
    """
    key = ["field", "family", "n"]
    lives = parents.where("built_at is not null").select(*key, F.col("built_at").alias("from"), F.coalesce("removed_at", F.lit("9999-12-31 00:00:00").cast(parents.schema["removed_at"].dataType)).alias("to"))
    sizes = lives.groupBy(*key).agg(F.count("*").alias("lives"), F.min("from").alias("from"), F.max("to").alias("to"))
    # Nearly all keys have one parent, and then there is nothing to merge and nothing to sort.
    single = sizes.where("lives = 1").select(*key, F.array(F.struct("from", "to")).alias("spans"), F.col("from").alias("newest"))
    many = lives.join(sizes.where("lives > 1").select(*key, (F.col("lives") >= hot_rows).alias("hot")), key).withColumn("newest", F.col("from"))
    by_month = _merged(many.where("hot").drop("hot").withColumn("month", F.trunc("from", "MM")), [*key, "month"]).drop("month")
    spans = _merged(many.where("not hot").drop("hot").unionByName(by_month), key)
    return spans.groupBy(*key).agg(F.collect_list(F.struct("from", "to")).alias("spans"), F.max("newest").alias("newest")).unionByName(single)


def parent_rows(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows that references may name, as (field, key, built_at, removed_at)."""
    by_doc = docs.select(F.lit("dst_doc").alias("field"), plain_key(F.col("doc_key")).alias("key"), "built_at", "removed_at")
    by_chunk = chunks.select(F.lit("dst_chunk").alias("field"), F.col("id").alias("key"), "built_at", "removed_at")
    by_label = chunks.select(F.lit("dst_label").alias("field"), F.concat_ws("\u0003", plain_key(F.col("doc_key")), plain_label(F.col("label"))).alias("key"), "built_at", "removed_at").where(F.col("label").isNotNull() & F.col("doc_key").isNotNull())
    return by_doc.unionByName(by_chunk.where("key is not null")).unionByName(by_label).where("key is not null")


def reference_rows(links: DataFrame) -> DataFrame:
    """Every reference that a link makes, as (id, made_at, field, key)."""
    doc = plain_key(F.col("dst_doc"))
    label = F.when(F.col("dst_doc").isNotNull() & F.col("dst_label").isNotNull(), F.concat_ws("\u0003", doc, plain_label(F.col("dst_label"))))
    three = F.array(F.struct(F.lit("dst_doc").alias("field"), doc.alias("key")), F.struct(F.lit("dst_chunk").alias("field"), F.col("dst_chunk").alias("key")), F.struct(F.lit("dst_label").alias("field"), label.alias("key")))
    return links.select("id", "made_at", F.explode(three).alias("r")).select("id", "made_at", "r.field", "r.key")


def orphans(links: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (id, made_at, field, reason) of links whose dst_doc, dst_chunk or dst_label names what does not exist.

    Reasons: `missing`, `late` (built after made_at only), `deleted`. Nulls: a null dst_chunk or dst_label is no reference; a
    null dst_doc has no docs row and is `missing`; with a null made_at nothing exists and nothing is later, so what is held
    is `deleted`. Links repeated under another id are reported each; a whole row repeated is reported once. Empty tables and
    extra columns are of no effect. A label counts only where dst_doc has a docs row.
    """
    # Both tables are read several times below; as written tables they are made once, and the plan stays small.
    parents = cut(keyed(parent_rows(docs, chunks), "key").select("field", "family", "block", "n", "built_at", "removed_at"))
    references = reference_rows(links.select("id", "made_at", "dst_doc", "dst_chunk", "dst_label").distinct())
    known = references.where("key is not null")
    asked = keyed(known.groupBy("field", "key").agg(F.count("*").alias("asks")), "key").withColumn("doc", F.when(F.col("field") == "dst_label", F.element_at(F.split("key", "\u0003"), 1)))
    met = beyond_runs(asked.select("field", "family", "block", "n", "key", "asks", "doc"), runs(parents))
    life = lifetimes(parents)
    status = met.join(life, ["field", "family", "n"], "left")
    held_docs = docs.where("doc_key is not null").select(plain_key(F.col("doc_key")).alias("doc")).distinct()
    labels = status.where("field = 'dst_label'").join(held_docs, "doc", "left_semi")
    status = status.where("field <> 'dst_label'").unionByName(labels).withColumn("slot", F.concat_ws("\u0004", "field", "key")).withColumn("found", F.lit(True))
    status = cut(status.select("slot", "asks", "held", "spans", "newest", "found"))
    each = spread_join(known.withColumn("slot", F.concat_ws("\u0004", "field", "key")), status, "slot", "asks", ["held", "spans", "newest", "found"])
    alive = F.exists("spans", lambda s: (s["from"] <= F.col("made_at")) & (s["to"] > F.col("made_at")))
    reason = F.when(~F.col("held"), "missing").when(F.coalesce(alive, F.lit(False)), None).when(F.col("newest") > F.col("made_at"), "late").otherwise("deleted")
    named = each.where("found").select("id", "made_at", "field", reason.alias("reason")).where("reason is not null")
    nameless = references.where("key is null and field = 'dst_doc'").select("id", "made_at", "field", F.lit("missing").alias("reason"))
    return named.unionByName(nameless).distinct()


def orphans_by_month(found: DataFrame) -> DataFrame:
    """How many orphans of each field and reason were made in each month."""
    return found.groupBy(F.date_format("made_at", "yyyy-MM").alias("month"), "field", "reason").agg(F.count("*").alias("orphans"))

