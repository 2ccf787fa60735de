"""Reads of the citation graph: heads of continued chunks, runs, timelines, citing texts, states as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.best import first_rows

CONTINUED = " (cont.)"
#: Kinds that change a text, the strongest first.
STRENGTH = {"replaces": 0, "repeals": 1, "inserts": 2, "amends": 3}


def base_path(path: Column) -> Column:
    return F.when(path.endswith(CONTINUED), path.substr(F.lit(1), F.length(path) - len(CONTINUED))).otherwise(path)


def heads(chunks: DataFrame) -> DataFrame:
    """(id, head): for a continued chunk the nearest chunk before it in its document with the path it continues; else itself."""
    path = base_path(F.col("crumb"))
    window = Window.partitionBy("doc_key", "_base").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(~F.coalesce(F.col("crumb").endswith(CONTINUED), F.lit(False)), F.col("id"))
    return chunks.select("id", "doc_key", "seq", "crumb", path.alias("_base")).select("id", F.last(own, ignorenulls=True).over(window).alias("head"))


def section_runs(chunks: DataFrame, most: int = 8) -> DataFrame:
    """(head, pieces, more): a section as its head and the continued chunks that follow without a gap, at most so many, and whether there are more."""
    base = base_path(F.col("crumb"))
    path = Window.partitionBy("doc_key", "_base").orderBy("seq")
    marked = chunks.where("crumb is not null").select("id", "doc_key", "seq", "crumb", base.alias("_base"))
    marked = marked.withColumn("_start", F.when(~F.col("crumb").endswith(CONTINUED) | (F.col("seq") - F.lag("seq").over(path) != 1), 1).otherwise(0))
    marked = marked.withColumn("_run", F.sum("_start").over(path))
    run = Window.partitionBy("doc_key", "_base", "_run").orderBy("seq")
    placed = marked.withColumn("_place", F.row_number().over(run)).withColumn("_head", F.first("id").over(run)).withColumn("_headed", ~F.first("crumb").over(run).endswith(CONTINUED))
    return placed.where("_headed").groupBy(F.col("_head").alias("head")).agg(F.least(F.count("*"), F.lit(most)).alias("pieces"), (F.count("*") > most).alias("more"))


def timeline(links: DataFrame) -> DataFrame:
    """(dst_doc, src_doc, first_made): the documents that change each document, with the first time of each."""
    return links.where(F.col("kind").isin(*STRENGTH) & (F.col("src_doc") != F.col("dst_doc"))).groupBy("dst_doc", "src_doc").agg(F.min("made_at").alias("first_made"))


def changes_into(links: DataFrame, head_of: DataFrame) -> DataFrame:
    """(chunk, id, kind, src_chunk, src_doc, made_at): links that change each chunk or its head, under the chunk's own id."""
    change = links.where(F.col("kind").isin(*STRENGTH) & F.col("dst_chunk").isNotNull()).select("id", "kind", "src_chunk", "src_doc", "dst_chunk", "made_at")
    wanted = head_of.select(F.col("id").alias("chunk"), F.explode(F.array_distinct(F.array("id", F.coalesce("head", "id")))).alias("dst_chunk"))
    return change.join(wanted, "dst_chunk").select("chunk", "id", "kind", "src_chunk", "src_doc", "made_at")


def as_of(changes: DataFrame, moment) -> DataFrame:
    """(chunk, src, kind, made_at, applies): one row for each changing section with its strongest kind, applied by the moment or later."""
    strength = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in STRENGTH.items()])
    folded = changes.groupBy("chunk", F.coalesce("src_chunk", "src_doc").alias("src")).agg(F.min(F.struct(strength.alias("s"), F.col("kind"))).alias("k"), F.min("made_at").alias("made_at"))
    return folded.select("chunk", "src", F.col("k.kind").alias("kind"), "made_at", (F.col("made_at").isNull() | (F.col("made_at") <= moment)).alias("applies"))


def cited_by(links: DataFrame, citing: Column) -> DataFrame:
    """(dst_chunk, src_doc, passage, passages, total): texts citing each chunk, the first passage of each, and how many texts there are."""
    cites = links.where((F.col("kind") == "cites") & F.col("dst_chunk").isNotNull() & citing)
    per = cites.groupBy("dst_chunk", "src_doc").agg(F.min_by("src_chunk", "id").alias("passage"), F.count("*").alias("passages"))
    return per.withColumn("total", F.count("*").over(Window.partitionBy("dst_chunk")))


def change_status(changes: DataFrame) -> DataFrame:
    """(chunk, sections, last_change, last_repeal) of each changed chunk."""
    return changes.groupBy("chunk").agg(F.count_distinct(F.coalesce("src_chunk", "src_doc")).alias("sections"), F.max("made_at").alias("last_change"), F.max(F.when(F.col("kind") == "repeals", F.col("made_at"))).alias("last_repeal"))


def links_of(links: DataFrame, way: str, kinds: list[str], most: int) -> DataFrame:
    """(doc, id, rank): the newest links of some kinds (all, if none is given) out of each document or `in`to it, at most so many; links of a document to itself aside."""
    doc = {"out": "src_doc", "in": "dst_doc"}[way]
    own = links.where(F.col("src_doc") != F.col("dst_doc"))
    own = own.where(F.col("kind").isin(*kinds)) if kinds else own
    return first_rows(own.select(F.col(doc).alias("doc"), "id", "made_at"), ["doc"], [F.desc_nulls_last("made_at"), F.desc("id")], most).select("doc", "id", "rank")


def history(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_key, laws, first_change, last_change, changes): how many laws change each document and when, and the law that it changes first."""
    change = links.where(F.col("kind").isin(*STRENGTH) & (F.col("src_doc") != F.col("dst_doc")))
    into = change.groupBy(F.col("dst_doc").alias("doc_key")).agg(F.count_distinct("src_doc").alias("laws"), F.min("made_at").alias("first_change"), F.max("made_at").alias("last_change"))
    first = links.where((F.col("kind") == "amends_act") & (F.col("src_doc") != F.col("dst_doc"))).groupBy(F.col("src_doc").alias("doc_key")).agg(F.min_by("dst_doc", "id").alias("changes"))
    return docs.join(into, "doc_key", "left").join(first, "doc_key", "left").select("doc_key", F.coalesce("laws", F.lit(0)).alias("laws"), "first_change", "last_change", "changes")


def status_sentence(status: DataFrame) -> DataFrame:
    """Adds `status` in words to (sections, last_change, last_repeal)."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    part = lambda words, c: F.coalesce(F.concat(F.lit(words), day(c)), F.lit(""))
    count = F.concat(F.lit("Changed by "), F.col("sections").cast("string"), F.when(F.col("sections") == 1, " section").otherwise(" sections"))
    return status.withColumn("status", F.concat(count, part(", last on ", "last_change"), part("; repealed on ", "last_repeal"), F.lit(".")))


def whole_sections(chunks: DataFrame, most: int = 8) -> DataFrame:
    """(head, pieces, text): the sections of a document put together from their head and the continued chunks after it, at most so many."""
    path = Window.partitionBy("doc_key", "_base").orderBy("seq")
    marked = chunks.where("crumb is not null").select("id", "doc_key", "seq", "text", F.col("crumb").endswith(CONTINUED).alias("_cont"), base_path(F.col("crumb")).alias("_base"))
    marked = marked.withColumn("_start", F.when(~F.col("_cont") | (F.col("seq") - F.lag("seq").over(path) != 1), 1).otherwise(0)).withColumn("_run", F.sum("_start").over(path))
    placed = marked.withColumn("_n", F.row_number().over(Window.partitionBy("doc_key", "_base", "_run").orderBy("seq"))).where(F.col("_n") <= most)
    rows = placed.groupBy("doc_key", "_base", "_run").agg(F.array_sort(F.collect_list(F.struct("_n", "id", "_cont", "text"))).alias("r")).where("not r[0]._cont")
    return rows.select(F.col("r")[0]["id"].alias("head"), F.size("r").cast("long").alias("pieces"), F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("text"))
