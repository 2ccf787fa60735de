"""Change detection between two snapshots, state fingerprints and differences of bags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): `new`, `gone`, `changed` or `same`, by null-safe comparison of all other columns of new."""
    rest = [c for c in new.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*key, F.struct(*rest).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "gone").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, change.alias("change"))


def last_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by order; of rows that are equal in it the greatest."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max(F.struct(*[F.col(o).alias(f"_o{n}") for n, o in enumerate(order)], F.struct(*rest).alias("_row"))).alias("_last"))
    return last.select(*key, "_last._row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """The next snapshot: rows of new, and those of old whose key isn't in new. Of a key twice in new the last by order (all columns) counts."""
    chosen = last_of(new.select(*old.columns), key, order or [c for c in old.columns if c not in key])
    return chosen.unionByName(old.join(new.select(*key), key, "left_anti").select(*old.columns))


def merge_upsert(old: DataFrame, new: DataFrame, key: list[str], order: str, json: str) -> DataFrame:
    """The next snapshot with `change`: inserted, changed, same or kept (in old alone).

    Of a key that stands twice on a side the last by order counts. The JSON map of a new row is laid over the old one's, key by
    key; a row is changed only if something differs after that, so that what is the same isn't written again.
    """
    rest = [c for c in new.columns if c not in key]
    a = last_of(old, key, [order]).select(*key, F.struct(*rest).alias("_old"))
    b = last_of(new, key, [order]).select(*key, F.struct(*rest).alias("_new"))
    met = a.join(b, key, "full_outer")
    laid = F.map_from_entries(F.array_sort(F.map_entries(F.map_zip_with(F.from_json(f"_old.{json}", "map<string,string>"), F.from_json(f"_new.{json}", "map<string,string>"), lambda k, x, y: F.coalesce(y, x)))))
    before = F.map_from_entries(F.array_sort(F.map_entries(F.from_json(f"_old.{json}", "map<string,string>"))))
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    merged = F.when(both, F.to_json(laid)).otherwise(F.coalesce(f"_new.{json}", f"_old.{json}"))
    others = [c for c in rest if c != json]
    same = F.struct(*[F.col(f"_new.{c}") for c in others]).eqNullSafe(F.struct(*[F.col(f"_old.{c}") for c in others])) & F.to_json(laid).eqNullSafe(F.to_json(before))
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").when(same, "same").otherwise("changed")
    return met.select(*key, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in others], merged.alias(json), change.alias("change"))


def bag_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with their multiplicity lost or gained: (columns, lost, gained)."""
    columns = old.columns
    both = old.select(*columns, F.lit(1).alias("_o"), F.lit(0).alias("_n")).unionAll(new.select(*columns, F.lit(0), F.lit(1)))
    counted = both.groupBy(*columns).agg(F.sum("_o").alias("_o"), F.sum("_n").alias("_n"))
    return counted.where("_o <> _n").select(*columns, F.greatest(F.col("_o") - F.col("_n"), F.lit(0)).alias("lost"), F.greatest(F.col("_n") - F.col("_o"), F.lit(0)).alias("gained"))


def fingerprint(df: DataFrame, key: list[str], lines, order: list[str], to: str = "fingerprint", block: int = 1000) -> DataFrame:
    """(key, to): the MD5 of the rows' lines in order, block by block: a row's place is its order, never its arrival.

    The rows fall into blocks by the first of their order columns, a number; a block's hash is that of its lines, and the whole's
    that of the blocks' in order, so that no row holds all lines of a key.
    """
    place = F.coalesce(F.floor(F.col(order[0]) / block), F.lit(-1)).alias("_block")
    rows = df.select(*key, place, F.struct(*[F.col(o) for o in order], lines.alias("_line")).alias("_row"))
    joined = lambda rows, part: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r[part]), "\n"))
    blocks = rows.groupBy(*key, "_block").agg(joined("_row", "_line").alias("_hash"))
    return blocks.groupBy(*key).agg(joined(F.struct("_block", "_hash"), "_hash").alias(to))


def planned(ledger: DataFrame, wanted: DataFrame, item: str, print_: str) -> DataFrame:
    """(item, plan): `new`, `redo` or `done` for wanted items against the ledger of fingerprints, `retire` for items no longer wanted."""
    a = ledger.select(F.col(item), F.col(print_).alias("_done"), F.lit(True).alias("_known"))
    b = wanted.select(F.col(item), F.col(print_).alias("_due"), F.lit(True).alias("_asked"))
    plan = F.when(F.col("_asked").isNull(), "retire").when(F.col("_known").isNull(), "new").when(F.col("_done").eqNullSafe(F.col("_due")), "done").otherwise("redo")
    return a.join(b, item, "full_outer").select(item, plan.alias("plan"))
