"""Joins whose probe side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with as many probe rows or more is hot. At most (probe rows / HOT_ROWS) keys can be hot, which bounds the broadcast.
HOT_ROWS = 200_000


def spread_join(big: DataFrame, small: DataFrame, key: str, rows: str, payload: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of big with small, which has one row a key (its first column) and in column `rows` the number of rows that big has of it.

    Hot keys, of which there are few by their definition, meet their rows by broadcast, and those rows enter the shuffle
    under a null key spread by their hash, so that no task gets them all. All other keys join by shuffle.
    """
    own = small.columns[0]
    hot = small.where(F.col(rows) >= hot_rows).select(F.col(own).alias("_hot"), F.struct(*payload).alias("_hot_row"))
    cold = small.where(F.col(rows) < hot_rows).select(F.col(own).alias("_cold"), F.lit(0).alias("_spread"), F.struct(*payload).alias("_cold_row"))
    met = big.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    met = met.withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(1 << 16)).cast("int")))
    joined = met.join(cold, (F.col(key) == F.col("_cold")) & (F.col("_salt") == F.col("_spread")), "left")
    pick = [F.coalesce(F.col("_hot_row"), F.col("_cold_row"))[c].alias(c) for c in payload]
    return joined.select(*[F.col(c) for c in big.columns if c not in payload], *pick)
