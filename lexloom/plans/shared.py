"""What the modules of queries share: normalised links, and SQL that both engines read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.keys import plain_key, tidy
from lexloom.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings listings docs chunks links sources size_limits eval_items".split()


def both(text: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A query and its SQL from one text in which tables stand in braces."""
    used = [t for t in TABLES if "{" + t + "}" in text]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, folder, t) for t in used})

    sql = text
    for t in used:
        sql = sql.replace("{" + t + "}", t)
    return run, sql


def plain_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links with tidy kinds and plain keys."""
    links = table(spark, folder, "links")
    return links.select("id", plain_key(F.col("src_doc")).alias("src_doc"), "src_chunk", tidy(F.col("kind")).alias("kind"), plain_key(F.col("dst_doc")).alias("dst_doc"), "dst_label", "dst_chunk", "part_named", "via_alias", "made_at")


def plain_sql(column: str) -> str:
    bare = rf"regexp_replace(lower(regexp_replace({column}, '\s+', '', 'g')), '(^|[^0-9])0+([0-9])', '\1\2', 'g')"
    return f"CASE WHEN regexp_matches({bare}, '^gazette:[0-9]+/[0-9]$') THEN replace({bare}, '/', '/0') ELSE {bare} END"


#: The same links in SQL.
LINKS = f"l AS (SELECT id, {plain_sql('src_doc')} AS src_doc, src_chunk, lower(trim(kind)) AS kind, {plain_sql('dst_doc')} AS dst_doc, dst_label, dst_chunk, made_at FROM links)"
