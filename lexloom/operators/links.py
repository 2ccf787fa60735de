"""Resolution of citations into links between chunks, by equi-joins over candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.best import best_per_key


def twins(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of each pair, once: (doc, twin); one step only."""
    return pairs.select(F.col(a).alias("doc"), F.col(b).alias("twin")).union(pairs.select(F.col(b), F.col(a))).where("doc <> twin").distinct()


def asked(mentions: DataFrame) -> DataFrame:
    """One row for each label of a mention (id, dst_doc, labels), or one with a null label if it names none."""
    labels = F.when(F.size("labels") > 0, F.col("labels"))
    return mentions.where("dst_doc is not null").select("id", "dst_doc", F.explode_outer(labels).alias("label")).distinct()


def candidates(targets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each target's document with preference 0 and its twins with preference 1: a union of equi-joins, never an OR."""
    own = targets.withColumn("doc", F.col("dst_doc")).withColumn("pref", F.lit(0))
    other = targets.join(pairs, targets.dst_doc == pairs.doc).select(*targets.columns, pairs.twin.alias("doc"), F.lit(1).alias("pref"))
    return own.unionByName(other)


def provision_links(targets: DataFrame, pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, label, dst_chunk, via_alias): for each labelled target the first chunk with that label, the document's own first."""
    named = candidates(targets.where("label is not null"), pairs)
    held = chunks.where("label is not null").select(F.col("doc_key").alias("doc"), "label", "seq", F.col("id").alias("dst_chunk"))
    met = named.join(held, ["doc", "label"]).withColumn("via_alias", F.col("doc") != F.col("dst_doc"))
    return best_per_key(met.select("id", "label", "pref", "seq", "dst_chunk", "via_alias"), ["id", "label"], [F.col("pref"), F.col("seq"), F.col("dst_chunk")]).select("id", "label", "dst_chunk", "via_alias")


def whole_links(targets: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, held_doc) for targets without a label: the first held document, the named one before its twins."""
    met = candidates(targets.where("label is null"), pairs).join(docs.select(F.col("doc_key").alias("doc")), "doc")
    return best_per_key(met.select("id", "doc", "pref"), ["id"], [F.col("pref"), F.col("doc")]).select("id", F.col("doc").alias("held_doc"))


def part_links(mentions: DataFrame, pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(id, part, label, dst_chunk) for mentions that repeal a Part or Chapter: one link for each unit under it.

    units has (doc_key, scope, label, seq, id); the prefix of the address is an equal scope, so this is an equi-join too.
    """
    parts = asked(mentions.where("kind = 'repeals'")).where(F.col("label").rlike("^(Part|Chapter) [IVXL]+[A-Z]?$"))
    under = candidates(parts, pairs).join(units.where("label is not null").select(F.col("doc_key").alias("doc"), F.col("scope").alias("label"), F.col("label").alias("unit"), "seq", F.col("id").alias("dst_chunk")), ["doc", "label"])
    first = best_per_key(under.select("id", "label", "pref", "doc").distinct(), ["id", "label"], [F.col("pref"), F.col("doc")]).select("id", "label", "doc")
    kept = under.join(first, ["id", "label", "doc"], "left_semi")
    return best_per_key(kept.select("id", F.col("label").alias("part"), F.col("unit").alias("label"), "seq", "dst_chunk"), ["id", "part", "label"], [F.col("seq"), F.col("dst_chunk")]).select("id", "part", "label", "dst_chunk")


def statuses(mentions: DataFrame, pairs: DataFrame, docs: DataFrame, provisions: DataFrame, wholes: DataFrame, inserted: DataFrame) -> DataFrame:
    """(id, status, unresolved) of each mention by the first rule that holds.

    `unidentified` without a document; `resolved` if all labels are linked; `not_held` if neither the document nor a twin is;
    `partial` if some are; `inserted` if each other label is one that a mention inserts into that document (doc, label);
    else `label_not_found`. unresolved holds the labels without a link, in order; null when resolved.
    """
    rows = asked(mentions)
    linked = provisions.select("id", "label", F.lit(True).alias("linked"))
    whole = wholes.select("id", F.lit(True).alias("whole"))
    put_in = inserted.select(F.col("doc").alias("dst_doc"), "label", F.lit(True).alias("put_in")).distinct()
    per = rows.join(linked, ["id", "label"], "left").join(whole, "id", "left").join(put_in, ["dst_doc", "label"], "left")
    ok = F.coalesce(F.when(F.col("label").isNull(), F.col("whole")).otherwise(F.col("linked")), F.lit(False))
    agg = per.groupBy("id").agg(
        F.bool_and(ok).alias("all_linked"),
        F.bool_or(ok).alias("some"),
        F.bool_and(ok | F.coalesce("put_in", F.lit(False))).alias("accounted"),
        F.array_sort(F.collect_set(F.when(~ok, F.col("label")))).alias("open"),
    )
    held = candidates(rows.select("id", "dst_doc").distinct(), pairs).join(docs.select(F.col("doc_key").alias("doc")), "doc", "left_semi").select("id").distinct().withColumn("held", F.lit(True))
    out = mentions.select("id", "dst_doc").join(agg, "id", "left").join(held, "id", "left")
    status = F.when(F.col("dst_doc").isNull(), "unidentified").when(F.col("all_linked"), "resolved").when(F.col("held").isNull(), "not_held").when(F.col("some"), "partial").when(F.col("accounted"), "inserted").otherwise("label_not_found")
    return out.select("id", status.alias("status"), F.when((status == "resolved") | (F.size("open") == 0), None).otherwise(F.col("open")).alias("unresolved"))
