"""Checks of a build, their gate against the previous one, scoring against gold, and the release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import gaps

#: At most this share of documents may fail a run, and at least so many may.
FAILURE_SHARE, FAILURES = 0.01, 3


def label_gaps(chunks: DataFrame) -> DataFrame:
    """(doc_key, gaps): the numbers that a document's units lack between 1 and the last, of those that lack any."""
    units = chunks.where("kind = 'unit' and label is not null").groupBy("doc_key").agg(F.collect_set("label").alias("labels"))
    return units.select("doc_key", F.array_sort(gaps(F.col("labels"))).alias("gaps")).where("size(gaps) > 0")


def mid_sentence(chunks: DataFrame) -> DataFrame:
    """Chunks that end inside a sentence although the next of the document begins with a small letter."""
    order = Window.partitionBy("doc_key").orderBy("seq", "id")
    looked = chunks.where("text is not null").select("id", "doc_key", F.rtrim("text").substr(-1, 1).alias("last"), F.lead(F.ltrim("text").substr(1, 1)).over(order).alias("next"))
    return looked.where(F.col("last").rlike("[a-z,]") & F.col("next").rlike("[a-z]")).select("id", "doc_key")


def builder_checks(chunks: DataFrame, docs: DataFrame, most: int = 1500) -> DataFrame:
    """(doc_key, check, severity) of everything that looks wrong in the chunks of built documents; one pass for what a chunk shows by itself."""
    text, unit = F.col("text"), F.col("kind") == "unit"
    letters, others = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit("[\u0d80-\u0dff\u0b80-\u0bff]"))
    alone = {
        ("too_long", "error"): F.length(text) > most,
        ("quoted_as_unit", "error"): unit & F.ltrim(text).rlike('^[“"]'),
        ("no_label", "warning"): unit & F.col("label").isNull() & F.coalesce(~F.col("crumb").endswith(" (cont.)"), F.lit(True)),
        ("heading_not_scope", "warning"): text.rlike(r"(?m)^(PART|CHAPTER) [IVXL]+\s*$"),
        ("other_script", "warning"): (letters >= 20) & (others > 0.5 * letters),
        ("rejected_opener", "warning"): ~unit & F.ltrim(text).rlike(r"^\d{1,3}[A-Z]{0,2}\. \S"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"))) for (c, s), on in alone.items()]))
    out = chunks.select("doc_key", F.explode(found).alias("i")).select("doc_key", "i.check", "i.severity")
    issue = lambda df, check, severity: df.select("doc_key", F.lit(check).alias("check"), F.lit(severity).alias("severity"))
    twice = chunks.where(unit & F.col("label").isNotNull()).groupBy("doc_key", "label").count().where("count > 1")
    empty = docs.select("doc_key").join(chunks.select("doc_key"), "doc_key", "left_anti")
    return out.unionAll(issue(mid_sentence(chunks), "mid_sentence", "warning")).unionAll(issue(twice, "duplicate_label", "error")).unionAll(issue(empty, "empty", "error"))


def gate(changed: DataFrame, accepted: DataFrame) -> DataFrame:
    """(doc_key, label, lost, reason, fails): labels lost, with the reason for which they are accepted, if they are.

    accepted has (doc_key, label, reason); a null label accepts all of the document's.
    """
    some = accepted.where("label is not null").groupBy("doc_key", "label").agg(F.min("reason").alias("_one"))
    whole = accepted.where("label is null").groupBy("doc_key").agg(F.min("reason").alias("_all"))
    met = changed.where("lost > 0").join(some, ["doc_key", "label"], "left").join(whole, "doc_key", "left")
    reason = F.coalesce("_one", "_all")
    return met.select("doc_key", "label", "lost", reason.alias("reason"), reason.isNull().alias("fails"))


def against_bars(scores: DataFrame, bars: dict[str, float], otherwise: float, by: str = "kind") -> DataFrame:
    """Scores with the bar of each kind and whether the precision reaches it."""
    bar = F.coalesce(*[F.when(F.col(by) == k, F.lit(b)) for k, b in bars.items()], F.lit(otherwise))
    return scores.withColumn("bar", bar).withColumn("reached", F.col("precision") >= F.col("bar"))


def labels_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_key, label, lost, gained) with multiplicity between two builds, of documents that both have."""
    shared = old.select("doc_key").distinct().join(new.select("doc_key").distinct(), "doc_key")
    a = old.where("label is not null").select("doc_key", "label", F.lit(1).alias("o"), F.lit(0).alias("n"))
    b = new.where("label is not null").select("doc_key", "label", F.lit(0).alias("o"), F.lit(1).alias("n"))
    counts = a.unionAll(b).join(shared, "doc_key", "left_semi").groupBy("doc_key", "label").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    return counts.where("o <> n").select("doc_key", "label", F.greatest(F.col("o") - F.col("n"), F.lit(0)).alias("lost"), F.greatest(F.col("n") - F.col("o"), F.lit(0)).alias("gained"))


def run_diff(before: DataFrame, after: DataFrame, identity: list[str]) -> DataFrame:
    """(identity, state): issues `fixed` or `new` between two runs, of documents (doc_key) that both runs checked."""
    both = before.select("doc_key").distinct().join(after.select("doc_key").distinct(), "doc_key")
    fixed = before.select(*identity).distinct().join(after.select(*identity), identity, "left_anti").withColumn("state", F.lit("fixed"))
    new = after.select(*identity).distinct().join(before.select(*identity), identity, "left_anti").withColumn("state", F.lit("new"))
    return fixed.unionByName(new).join(both, "doc_key", "left_semi")


def gold_scores(found: DataFrame, gold: DataFrame, key: list[str], by: str) -> DataFrame:
    """(by, found, expected, right, precision, recall) of found against gold rows, compared by key."""
    f = found.select(by, *key).distinct().withColumn("_f", F.lit(1))
    g = gold.select(by, *key).distinct().withColumn("_g", F.lit(1))
    both = f.join(g, [by, *key], "full_outer").groupBy(by).agg(F.count("_f").alias("found"), F.count("_g").alias("expected"), F.sum(F.when(F.col("_f").isNotNull() & F.col("_g").isNotNull(), 1).otherwise(0)).alias("right"))
    return both.withColumn("precision", F.round(F.col("right") / F.nullif("found", F.lit(0)), 6)).withColumn("recall", F.round(F.col("right") / F.nullif("expected", F.lit(0)), 6))


def review(issues: DataFrame, most: int = 60) -> DataFrame:
    """The documents with the most errors, then warnings: (doc_key, errors, warnings)."""
    counts = issues.groupBy("doc_key").agg(F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"))
    return counts.orderBy(F.desc("errors"), F.desc("warnings"), "doc_key").limit(most)


def summary(issues: DataFrame, top: int = 4) -> DataFrame:
    """(check, severity, issues, documents, causes): the counts of each check and its most frequent causes."""
    per = issues.groupBy("check", "severity").agg(F.count("*").alias("issues"), F.count_distinct("doc_key").alias("documents"))
    causes = issues.groupBy("check", "severity", "cause").agg(F.count("*").alias("n"))
    place = Window.partitionBy("check", "severity").orderBy(F.desc("n"), "cause")
    best = causes.withColumn("p", F.row_number().over(place)).where(F.col("p") <= top).groupBy("check", "severity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "cause", "n"))), lambda c: F.concat_ws("=", c["cause"], c["n"])), ",").alias("causes"))
    return per.join(best, ["check", "severity"], "left")


def within_budget(failed: Column, all_: Column) -> Column:
    return failed <= F.greatest(F.lit(FAILURES), all_ * FAILURE_SHARE)


def release(published: DataFrame, state: DataFrame, gate: DataFrame) -> DataFrame:
    """(doc_key, action) of a release: `replace` where the fingerprint differs and the gate passed that state, `remove` what is gone,
    `hold` what changed without having passed, `keep` the rest. All three hold (doc_key, fingerprint)."""
    a = published.select("doc_key", F.col("fingerprint").alias("_was"))
    b = state.select("doc_key", F.col("fingerprint").alias("_is"))
    passed = gate.select("doc_key", F.col("fingerprint").alias("_is"), F.lit(True).alias("_ok")).distinct()
    met = a.join(b, "doc_key", "full_outer").join(passed, ["doc_key", "_is"], "left")
    action = F.when(F.col("_is").isNull(), "remove").when(F.col("_was").eqNullSafe(F.col("_is")), "keep").when(F.col("_ok"), "replace").otherwise("hold")
    return met.select("doc_key", action.alias("action"))


def embedding_changes(held: DataFrame, chunks: DataFrame, least: int = 40) -> DataFrame:
    """(id, action): `upsert` where the text's hash differs or is new, `delete` where the text is gone or too short, else none."""
    due = chunks.where(F.length("text") >= least).select("id", F.col("text_hash").alias("_due"))
    met = held.select("id", F.col("text_hash").alias("_held")).join(due, "id", "full_outer")
    return met.select("id", F.when(F.col("_due").isNull(), "delete").when(~F.col("_due").eqNullSafe(F.col("_held")), "upsert").alias("action")).where("action is not null")


def published(old: DataFrame, state: DataFrame, actions: DataFrame) -> DataFrame:
    """The next release: the rows of state for documents that are replaced or new to it, and of the old release for what is kept or held.

    All rows carry doc_key; documents that are removed, and those of state that are held without an old row, aren't in it.
    """
    taken = state.join(actions.where("action = 'replace'").select("doc_key"), "doc_key", "left_semi")
    carried = old.join(actions.where("action in ('keep', 'hold')").select("doc_key"), "doc_key", "left_semi")
    return taken.unionByName(carried.select(taken.columns))
