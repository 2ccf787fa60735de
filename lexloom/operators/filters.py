"""Filters built from what a user asks for; values are literals of expressions and never text of a query."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of a corpus that a search may be confined to, with the beginnings of their keys.
ONLY = {
    "laws": ("act:", "law:", "ordinance:", "cap:", "cap1956:", "amendment:", "constitution"),
    "judgments": ("ca:", "sc:"),
    "courtOfAppeal": ("ca:",),
    "supremeCourt": ("sc:",),
}


@dataclass(frozen=True)
class LawFilter:
    """Documents of given keys or kinds, of one part of the corpus, of years between two; what isn't given filters nothing."""

    doc_keys: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    only: str | None = None
    year_from: float | None = None
    year_to: float | None = None

    def __post_init__(self) -> None:
        if self.only is not None and self.only not in ONLY:
            raise ValueError(f"unknown part of the corpus: {self.only!r}")
        for year in (self.year_from, self.year_to):
            if year is not None and not math.isfinite(year):
                raise ValueError(f"no year: {year!r}")

    def column(self, key: Column, kind: Column, year: Column) -> Column:
        out = F.lit(True)
        if self.doc_keys:
            out &= key.isin(*self.doc_keys)
        if self.kinds:
            out &= kind.isin(*self.kinds)
        if self.only:
            begins = F.lit(False)
            for start in ONLY[self.only]:
                begins |= key.startswith(start)
            out &= begins
        if self.year_from is not None:
            out &= year >= math.trunc(self.year_from)
        if self.year_to is not None:
            out &= year <= math.trunc(self.year_to)
        return F.coalesce(out, F.lit(False))


def in_scopes(scopes: Column, allowed: list[str]) -> Column:
    """Whether a row has one of the allowed scopes; nothing is allowed if none is."""
    if not allowed:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(scopes, F.array(*[F.lit(a) for a in allowed])), F.lit(False))


def has_all_words(text: Column, asked: str) -> Column:
    """Whether a text holds each word of what is asked, in any letter case; signs of patterns stand for themselves."""
    out = F.lit(True)
    for word in asked.split():
        for sign in ("\\", "%", "_"):
            word = word.replace(sign, f"\\{sign}")
        out &= text.ilike(f"%{word}%")
    return out
