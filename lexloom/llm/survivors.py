"""One surviving record for each group of records of the same document, field by field."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.instants import listing_norms
from lexloom.functions.keys import plain_key, tidy
from lexloom.tables import cut

#: Spellings of the labels, and of values that stand in for none.
LABELS = {
    "ENGLISH": ["english", "eng", "en"],
    "SINHALA": ["sinhala", "sinhalese", "sin", "si"],
    "TAMIL": ["tamil", "tam", "ta"],
}
#: Sources that truth discovery tells apart.
MOST_SOURCES = 200
STAND_INS = ["untitled", "na", "none", "null", "nil", "notitle", "titlenotavailable", "notavailable", "unknown", "tba", "tbd", "title"]


def language_label(label: Column) -> Column:
    """ENGLISH, SINHALA or TAMIL for any spelling of a label; null for what names none of them."""
    bare = F.regexp_replace(F.lower(label), r"[^\p{L}]", "")
    out = F.lit(None).cast("string")
    for name, spellings in LABELS.items():
        out = F.when(bare.isin(spellings), name).otherwise(out)
    return out


def has_content(title: Column) -> Column:
    bare = F.regexp_replace(F.lower(title), r"[^\p{L}\p{M}\p{N}]", "")
    return F.coalesce((bare != "") & ~bare.isin(STAND_INS), F.lit(False))


def survivors(listings: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_key, listing_id, title_from, date_from, listings) for each document that two or more listings name.

    A fixed order of preference, as this result asks for: a pinned listing, the language as labelled (English, Sinhala,
    Tamil, none), the source's trust (1 first, unknown last), the later last_seen, the higher id. One aggregate of structs
    finds all three, so a document with a third of all listings is combined before the shuffle and never gathered. A null key
    names nothing; repeated rows count once; a null last_seen is earliest; pins for other documents count for nothing.
    """
    dated = listing_norms(listings.select("id", "source", "listed_key", "title", "date", "date_precision", "language", "last_seen"), sources)
    trust = sources.where("source is not null").groupBy(F.col("source").alias("_source")).agg(F.min("trust").alias("_trust"))
    pins = documents.where(tidy(F.col("chosen_by")) == "pin").where("listing_id is not null").select(plain_key(F.col("doc_key")).alias("_doc"), F.col("listing_id").alias("_pinned")).distinct()
    named = dated.withColumn("doc_key", plain_key(F.col("listed_key"))).where("doc_key is not null").join(trust, F.col("source") == F.col("_source"), "left")
    named = named.join(pins, (F.col("doc_key") == F.col("_doc")) & (F.col("id") == F.col("_pinned")), "left")
    language = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in {"ENGLISH": -1, "SINHALA": -2, "TAMIL": -3}.items() for x in kv]), language_label(F.col("language"))), F.lit(-4))
    order = F.struct(F.col("_pinned").isNotNull().alias("pin"), language.alias("language"), (-F.coalesce(F.col("_trust"), F.lit(1 << 30))).alias("trust"), F.col("last_seen"), F.col("id"))
    ranked = named.select("doc_key", order.alias("order"), has_content(F.col("title")).alias("titled"), (F.col("norm").isNotNull() & (F.col("norm") != "none")).alias("dated"))
    grouped = ranked.groupBy("doc_key").agg(F.max("order").alias("o"), F.max(F.when(F.col("titled"), F.col("order"))).alias("t"), F.max(F.when(F.col("dated"), F.col("order"))).alias("d"), F.min("order.id").alias("least"), F.max("order.id").alias("most"), F.count("*").alias("listings"))
    several = grouped.where("least <> most")
    return several.select("doc_key", F.col("o.id").alias("listing_id"), F.coalesce("t.id", F.lit(0)).cast("long").alias("title_from"), F.coalesce("d.id", F.lit(0)).cast("long").alias("date_from"), "listings")


def claims(listings: DataFrame, sources: DataFrame) -> DataFrame:
    """What each source says of each document's fields: (doc_key, field, value, source), each once."""
    dated = listing_norms(listings.select("id", "source", "listed_key", "title", "date", "date_precision", "language"), sources).withColumn("doc_key", plain_key(F.col("listed_key")))
    said = F.array(
        F.struct(F.lit("title").alias("field"), F.when(has_content(F.col("title")), F.regexp_replace(F.trim("title"), r"[\s.]+$", "")).alias("value")),
        F.struct(F.lit("date").alias("field"), F.when(F.col("norm") != "none", F.col("norm")).alias("value")),
        F.struct(F.lit("language").alias("field"), language_label(F.col("language")).alias("value")),
    )
    return dated.where("doc_key is not null and source is not null").select("doc_key", "source", F.explode(said).alias("c")).select("doc_key", "c.field", "c.value", "source").where("value is not null").distinct()


def truth_discovery(said: DataFrame, rounds: int = 10, enough: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(doc_key, field, value, support) with the highest-supported value of each field, and (source, reliability).

    In turn, a value's support is the sum of the log odds of the sources that claim it, and a source's reliability the share
    of its claims that are the best supported, until no reliability moves by more than `enough`. Claims without a rival, and
    those of values that tie, tell nothing of a source and are left out of its reliability. Ties go to the value that comes last by bytes.
    Claims that repeat another, and those with a null, count for nothing. No claims, no rows.

    A row is a value with the numbers of its sources, so that a round is one aggregate over rows that lie still: it combines
    before the shuffle, whatever share of all values one document has, and nothing is joined. The sources are a reference
    table; their names and reliabilities, no more than MOST_SOURCES, are what passes through the driver.
    """
    spark = said.sparkSession
    known = said.where("source is not null").select("source").distinct().orderBy("source").limit(MOST_SOURCES + 1).collect()
    names = [r.source for r in known]
    if len(names) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("source")).cast("int") if names else F.lit(0)
    whole = said.where("doc_key is not null and field is not null and value is not null and source is not null")
    values = cut(whole.groupBy("doc_key", "field", "value").agg(F.collect_set(place).alias("by")))
    # Only values with a rival tell of sources; they are picked out once, and the rounds go over them alone.
    rivals = values.groupBy("doc_key", "field").agg(F.count("*").alias("rivals")).where("rivals > 1").select("doc_key", "field")
    contested = cut(values.join(rivals, ["doc_key", "field"], "left_semi"))
    reliability = [0.8] * len(names)

    def supported(values: DataFrame) -> DataFrame:
        odds = F.array(*[F.lit(max(0.01, math.log(r / (1 - r)))) for r in reliability]) if names else F.array().cast("array<double>")
        # The sources in their order, so that a sum is the same whatever the order of rows.
        return values.withColumn("support", F.aggregate(F.array_sort("by"), F.lit(0.0), lambda total, i: total + F.element_at(odds, i)))

    for _ in range(rounds if names else 0):
        best = supported(contested).groupBy("doc_key", "field").agg(
            F.max(F.struct("support", "value", "by")).alias("best"), F.min(F.struct((-F.col("support")).alias("s"), F.col("value"))).alias("same"),
            *[F.count(F.when(F.array_contains("by", i), 1)).alias(f"n{i}") for i in range(1, len(names) + 1)])
        told = best.where("best.value = same.value").agg(*[f(i) for i in range(1, len(names) + 1) for f in (lambda i: F.sum(f"n{i}").alias(f"n{i}"), lambda i: F.count(F.when(F.array_contains("best.by", i), 1)).alias(f"r{i}"))]).first()
        after = [min(0.99, (told[f"r{i}"] + 4) / (told[f"n{i}"] + 5)) if told[f"n{i}"] else r for i, r in enumerate(reliability, 1)]
        moved = max(abs(x - y) for x, y in zip(after, reliability, strict=True))
        reliability = after
        if moved <= enough:
            break
    best = supported(values).groupBy("doc_key", "field").agg(F.max(F.struct("support", "value")).alias("best"))
    return best.select("doc_key", "field", "best.value", "best.support"), spark.createDataFrame(list(zip(names, reliability, strict=True)), "source string, reliability double")
