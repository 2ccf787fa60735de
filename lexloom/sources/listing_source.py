"""Listings landed as compressed JSON lines, as a Python data source: one partition a file, rows as Arrow batches.

Files on other file systems than this machine's are reached through Arrow's, so that the folder may be on any that the workers share. A filter by source is
taken by the reader with the option `pushdown`, which the session must allow (`spark.sql.python.filterPushdown.enabled`); a line that can't be read comes out
in the column `unread` with all others null, so that it can be counted.
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

FIELDS = ["source", "source_url", "title", "date", "listing", "unread"]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def local_path(uri: str) -> str | None:
    """The path of a file on this machine; None for one on another file system."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def opened(uri: str):
    if local := local_path(uri):
        return open(local, "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression=None)


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.source: str | None = None

    def partitions(self) -> list[InputPartition]:
        if local := local_path(self.folder):
            files = [str(p) for p in Path(local).iterdir() if p.is_file()]
        else:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(self.folder)
            files = [f"{self.folder.rstrip('/')}/{f.base_name}" for f in system.get_file_info(fs.FileSelector(path)) if f.is_file]
        wanted = [f for f in files if ".json" in (name := f.rpartition("/")[2]) and name[0] not in "._"]
        return [_File(f) for f in sorted(wanted)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        schema = pa.schema([(f, pa.string()) for f in FIELDS])
        rows: list[dict] = []
        with opened(partition.path) as stream:
            lines = gzip.open(stream, "rt", encoding="utf-8") if partition.path.endswith(".gz") else io.TextIOWrapper(stream, encoding="utf-8")
            for line in lines:
                try:
                    row = json.loads(line)
                    row = {f: row.get(f) for f in FIELDS[:-1]}
                except (ValueError, AttributeError):
                    row = {"unread": line.rstrip("\n")}
                if self.source is None or row.get("source") == self.source:
                    rows.append(row)
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class FilteringReader(ListingReader):
    """Takes a filter by source, so that other rows don't leave the reader."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source",) and isinstance(f.value, str) and self.source in (None, f.value):
                self.source = f.value
            else:
                yield f


class ListingSource(DataSource):
    """spark.dataSource.register(ListingSource); spark.read.format("landed_listings").option("path", folder).load()."""

    @classmethod
    def name(cls) -> str:
        return "landed_listings"

    def schema(self) -> str:
        return ", ".join(f"{f} string" for f in FIELDS)

    def reader(self, schema) -> ListingReader:
        return (FilteringReader if self.options.get("pushdown", "").lower() == "true" else ListingReader)(self.options)
