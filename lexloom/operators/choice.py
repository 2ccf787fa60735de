"""Choice of the file of each document among its listings, with what people have decided, and what is to be fetched, read or crawled again."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.keys import plain_key
from lexloom.operators.best import best_per_key

LANGUAGES = {"ENGLISH": 0, "SINHALA": 1, "TAMIL": 2}
#: A law's name, and what is published beside laws.
LAW_WORDS = r"(?i)\b(acts?|ordinances?|laws?|statutes?|code|constitution|bill)\b"
NOISE_WORDS = r"(?i)\b(gazettes?|notifications?|notices?|regulations?|orders?|by-laws?|vacanc(?:y|ies)|tenders?|auctions?)\b"


def names_law(description: Column) -> Column:
    """Whether a description is of a law: it has a word for one and none for what is published beside laws."""
    return F.coalesce(description.rlike(LAW_WORDS) & ~description.rlike(NOISE_WORDS), F.lit(False))


def candidates(listings: DataFrame, trust: DataFrame, held: DataFrame, pins: DataFrame, rejects: DataFrame, rekeys: DataFrame) -> DataFrame:
    """(doc_key, id, held, language, place_by): the listings that may be a document's file, and what they are ordered by.

    A listing takes the key of its rekey (listing, key), else its own; rejected ones (listing) are out; pinned (doc_key, listing)
    come first, then language, trust of the source, files that are held (listing), files at all, the lower id.
    """
    rekeyed = rekeys.groupBy(F.col("listing").alias("id")).agg(F.min("key").alias("_key"))
    rows = listings.join(rejects.select(F.col("listing").alias("id")), "id", "left_anti").join(rekeyed, "id", "left")
    rows = rows.withColumn("doc_key", plain_key(F.coalesce("_key", "listed_key"))).where("doc_key is not null")
    rows = rows.join(trust.groupBy("source").agg(F.min("trust").alias("_trust")), "source", "left")
    rows = rows.join(pins.select("doc_key", F.col("listing").alias("id"), F.lit(True).alias("_pin")).distinct(), ["doc_key", "id"], "left")
    rows = rows.join(held.select(F.col("listing").alias("id"), F.lit(True).alias("_held")).distinct(), "id", "left")
    language = F.coalesce(*[F.when(F.col("label") == name, F.lit(n)) for name, n in LANGUAGES.items()], F.lit(len(LANGUAGES)))
    order = F.struct(F.col("_pin").isNull().alias("unpinned"), language.alias("language"), F.coalesce("_trust", F.lit(1 << 30)).alias("trust"), F.col("_held").isNull().alias("unheld"), F.col("file_format").isNull().alias("no_file"), F.col("id"))
    return rows.select("doc_key", "id", F.coalesce("_held", F.lit(False)).alias("held"), language.alias("language"), order.alias("place_by"))


def choose(ranked: DataFrame) -> DataFrame:
    """(doc_key, chosen, fetch): the first candidate that is held, and the one to fetch.

    One is fetched where nothing is held, the first; or where a candidate in a better language than the chosen one isn't held,
    the first of those. One aggregate, so that a document with very many listings is combined before the shuffle.
    """
    least = lambda when: F.min(F.when(when, F.struct("place_by", "id", "language")))
    per = ranked.groupBy("doc_key").agg(least(F.col("held")).alias("h"), *[least(~F.col("held") & (F.col("language") == n)).alias(f"u{n}") for n in range(len(LANGUAGES) + 1)])
    first = F.least(*[F.col(f"u{n}") for n in range(len(LANGUAGES) + 1)])
    better = F.coalesce(*[F.when(F.lit(n) < F.col("h.language"), F.col(f"u{n}")) for n in range(len(LANGUAGES))])
    return per.select("doc_key", F.col("h.id").alias("chosen"), F.when(F.col("h").isNull(), first["id"]).otherwise(better["id"]).alias("fetch"))


def years_due(held: DataFrame, first: int, today: date) -> DataFrame:
    """(year): the years to crawl, those without a held one (year), this year, and the last one while it is January."""
    spark = held.sparkSession
    every = spark.range(first, today.year + 1).select(F.col("id").cast("int").alias("year"))
    again = [today.year] + ([today.year - 1] if today.month == 1 else [])
    missing = every.join(held.where("year is not null").select(F.col("year").cast("int").alias("year")), "year", "left_anti")
    return missing.union(every.where(F.col("year").isin(*again))).distinct()


def sniffed(content: Column) -> Column:
    """What a file is by its first characters: pdf, html or other; null without any."""
    start = F.ltrim(F.substring(content, 1, 64))
    return F.when(content.isNull() | (content == ""), None).when(start.startswith("%PDF"), "pdf").when(start.startswith("<"), "html").otherwise("other")


def content_address(content: Column) -> Column:
    """Where a file is stored: by the hash of its content, in folders by its first digits."""
    h = F.sha2(content, 256)
    return F.concat(F.substring(h, 1, 2), F.lit("/"), h)


def suppressed(listings: DataFrame, trust: DataFrame, official: int = 1) -> DataFrame:
    """(id, doc_key) of listings of other sources of documents that an official source lists."""
    ranked = listings.join(trust.groupBy("source").agg(F.min("trust").alias("_trust")), "source", "left").select("id", plain_key(F.col("listed_key")).alias("doc_key"), "_trust")
    own = ranked.where(F.col("_trust") <= official).select("doc_key").distinct()
    return ranked.where(F.coalesce(F.col("_trust") > official, F.lit(True))).join(own, "doc_key", "left_semi").select("id", "doc_key")


def canonical_rows(listings: DataFrame, path: str = "$.record") -> DataFrame:
    """(id, canonical): rows that repeat another by a value in their JSON, with the first row that has it."""
    rows = listings.select("id", F.get_json_object("listing", path).alias("value")).where("value is not null")
    first = rows.groupBy("value").agg(F.min("id").alias("canonical"), F.count("*").alias("n")).where("n > 1").select("value", "canonical")
    return rows.join(first, "value").where("id <> canonical").select("id", "canonical")


def seeded(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """One row a key from several tables with the same columns: that of the first table that has it, the first by order there."""
    every = None
    for n, part in enumerate(parts):
        own = part.withColumn("_part", F.lit(n))
        every = own if every is None else every.unionByName(own)
    return best_per_key(every.where(F.col(key).isNotNull()), [key], [F.col("_part"), F.col(order)]).drop("_part")
