"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.plans import cases, catalog, choosing, corpus, dealt, graph, layout, reading, search, streams, usage

MODULES = [dealt, graph, usage, search, catalog, choosing, cases, corpus, layout, reading, streams]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["resolve_links"](spark, folder)
