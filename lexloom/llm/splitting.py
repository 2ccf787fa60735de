"""Cutting oversized texts at natural boundaries by content-defined chunking."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blank, tab, line breaks and the no-break space.
WHITE = " \t\r\n "
#: Boundaries, the most natural first; each match ends where the next piece begins.
BOUNDARIES = [re.compile(r"\n[ \t\r ]*\n\s*"), re.compile(r"\n"), re.compile(r"[.!?;:]['\"”’)\]]*[ \t\r\n ]+"), re.compile(r"[ \t\r\n ]+")]
#: How far, as a share of a piece, a boundary of each class may lie from the landmark; words may lie anywhere.
REACH = (0.5, 0.35, 0.35, 1.0)
#: Characters of the rolling hash.
WIDTH = 16


def landmark(codes: np.ndarray, low: int, high: int) -> int:
    """The position in low..high with the smallest rolling hash of the characters before it; the last of equal ones."""
    start = max(0, low - WIDTH)
    span = codes[start:high].astype(np.uint64)
    if len(span) <= WIDTH:
        return high
    powers = np.array([pow(1099511628211, i, 1 << 64) for i in range(WIDTH)], dtype=np.uint64)
    rolled = sum(span[i : len(span) - WIDTH + 1 + i] * powers[i] for i in range(WIDTH))
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    ends = np.arange(start + WIDTH, high + 1)
    fit = ends >= low
    if not fit.any():
        return high
    values, ends = rolled[fit], ends[fit]
    return int(ends[len(values) - 1 - int(values[::-1].argmin())])


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start of the overlap, start, end) of each piece of text, none over limit characters with its overlap.

    Pieces between half and the whole of the limit end at the boundary nearest a landmark: a paragraph's end, else a line's,
    a sentence's or a word's; where no boundary lies there, at the last white space before, and only in a stretch without white
    space inside a character run. Every piece but the first repeats exactly overlap characters, or half the limit if that is less.
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit // 2))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    pieces, start = [], 0
    while True:
        back = min(overlap, start)
        room = limit - back
        if len(text) - start <= room:
            pieces.append((start - back, start, len(text)))
            return pieces
        low, high = start + max(1, room // 2), start + room
        pieces.append((start - back, start, end := cut_at(text, codes, start, low, high)))
        start = end


def cut_at(text: str, codes: np.ndarray, start: int, low: int, high: int) -> int:
    mark = landmark(codes, low, high)
    for boundary, reach in zip(BOUNDARIES, REACH, strict=True):
        near = reach * (high - low)
        # A match may run on past high, and then the piece ends inside the white space, at high.
        ends = [min(m.end(), high) for m in boundary.finditer(text, low - 1, min(len(text), high + 1)) if m.start() < high and low <= min(m.end(), high)]
        ends = [e for e in ends if abs(e - mark) <= near]
        if ends:
            return min(ends, key=lambda e: (abs(e - mark), e))
    for e in range(low, start, -1):
        if text[e - 1] in WHITE:
            return e
    return high


def split_texts(df: DataFrame, limits: DataFrame, keep_whole: bool = True) -> DataFrame:
    """(id, piece, start, text, label, limit, how) of the texts in df (id, kind, label, text), by limits (kind, max_chars, overlap_chars).

    A null kind and one without limits take the row `*`; without that row there is no limit. Texts within their limit stay
    one piece (left out with keep_whole=False), null texts give no piece, empty ones one. The label is on the first piece
    only. how is null for one piece, else `hard` if a stretch without white space is longer than the limit, or `natural`. Rows
    that repeat an id come out each; of repeated limits the smallest holds; a limit under 1 counts as 1.
    """
    rules = limits.groupBy("kind").agg(F.min("max_chars").alias("max_chars"), F.min("overlap_chars").alias("overlap_chars"))
    star = rules.where("kind = '*'").select(F.lit(1).alias("_one"), F.col("max_chars").alias("_star_max"), F.col("overlap_chars").alias("_star_overlap"))
    own = rules.where("kind <> '*'").select(F.col("kind").alias("_kind"), "max_chars", "overlap_chars")
    texts = df.select("id", "kind", "label", "text").where("text is not null").withColumn("_one", F.lit(1))
    texts = texts.join(own, F.col("kind") == F.col("_kind"), "left").join(F.broadcast(star), "_one", "left")
    texts = texts.select("id", "label", "text", F.coalesce("max_chars", "_star_max").cast("int").alias("limit"), F.coalesce(F.when(F.col("max_chars").isNotNull(), F.col("overlap_chars")), F.col("_star_overlap"), F.lit(0)).cast("int").alias("overlap"))
    over = F.col("limit").isNotNull() & (F.char_length("text") > F.greatest(F.col("limit"), F.lit(1)))
    schema = "id string, piece int, start int, text string, label string, limit int, how string"
    pieces = texts.where(over).mapInArrow(_split_batches, schema)
    if not keep_whole:
        return pieces
    whole = texts.where(~over).select("id", F.lit(1).alias("piece"), F.lit(0).alias("start"), "text", "label", "limit", F.lit(None).cast("string").alias("how"))
    return pieces.unionByName(whole)


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for id_, label, text, limit, overlap in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            stretch = max(map(len, re.split(f"[{WHITE}]+", text)))
            how = "hard" if stretch > max(1, limit) else "natural"
            rows += [(id_, i + 1, a, text[a:c], None if i else label, limit, how) for i, (a, _, c) in enumerate(split(text, limit, overlap))]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["id", "piece", "start", "text", "label", "limit", "how"])
