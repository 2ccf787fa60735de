"""Best row, first rows and last-wins rows per key, as aggregates that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], largest: bool = False) -> DataFrame:
    """One row per key: the first in the given order (the last with largest=True). The order must be total to be repeatable."""
    rest = [c for c in df.columns if c not in keys]
    ranked = df.select(*keys, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row")).alias("ranked"))
    pick = F.max if largest else F.min
    return ranked.groupBy(*keys).agg(pick("ranked").alias("ranked")).select(*keys, "ranked.row.*")


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows per key; Spark keeps only n rows a group before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
