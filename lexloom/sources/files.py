"""File sinks and their read-back: compressed JSON lines for crawl runs, CSV for backups, parts of bounded size for texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.tables import shared_folder

#: A part of a text store holds at most so many bytes, unless one unit alone is larger.
PART_BYTES = 256_000


def write_run(rows: DataFrame, name: str) -> str:
    """A run's rows as compressed JSON lines under a path of their own in the shared folder; returns the path."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "gzip").json(path)
    return path


def read_back(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def backup(rows: DataFrame, name: str) -> tuple[str, int, int]:
    """Rows as compressed CSV, read again: the path, the rows written and the rows that came back."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("header", True).option("compression", "gzip").option("escape", '"').option("multiLine", True).csv(path)
    back = rows.sparkSession.read.schema(rows.schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return path, rows.count(), back.count()


def text_parts(chunks: DataFrame, most: int = PART_BYTES) -> DataFrame:
    """(doc_key, part, first_seq, chunks, bytes, name): texts in their order put into parts of at most so many bytes; a larger text is a part of its own.

    A part is named by its content, so that one that is stored already needn't be written again. Documents pass through their
    task in order, and only the size of the part that is filled is held. Null texts are in no part.
    """
    rows = chunks.where("text is not null and doc_key is not null").select("doc_key", "seq", "id", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("hash"))
    placed = rows.repartition("doc_key").sortWithinPartitions("doc_key", "seq", "id")

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, part, held = None, 0, 0
        for frame in frames:
            parts = []
            for own, size in zip(frame["doc_key"], frame["size"], strict=True):
                if own != key:
                    key, part, held = own, 0, 0
                elif held and held + size > most:
                    part, held = part + 1, 0
                held += size
                parts.append(part)
            yield frame.assign(part=parts)

    filled = placed.mapInPandas(fill, "doc_key string, seq int, id string, size int, hash string, part int")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id", "hash"))), lambda r: r["hash"]), "")
    return filled.groupBy("doc_key", "part").agg(F.min("seq").alias("first_seq"), F.count("*").alias("chunks"), F.sum("size").alias("bytes"), F.sha2(ordered, 256).alias("name"))
