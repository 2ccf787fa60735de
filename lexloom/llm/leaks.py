"""Passages of evaluation items in a corpus, by windows of canonical templates.

Numbers and units become typed placeholders, and in a second reading names too, a name of several words as one. What a
placeholder is depends on the text it stands in and on nothing else. Equal placeholders of a window are one slot, and which
slots are equal is part of the window's hash, so that windows of one hash are alike with consistent slots. A shared run of WORDS
words or forms holds a whole block of BLOCK forms at a multiple of BLOCK of the text: the blocks of all texts are joined by hash
with the windows of all items, and in the texts that have one, every window of WORDS is joined with those of the items. Where
the words themselves agree, the passage has leaked; where only the forms do, a re-parameterised passage has.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.tables import cut, drop

#: Words in a row that make a leak, and words of a block: 2 * BLOCK - 1 <= WORDS, so that every leak holds a whole block.
WORDS, BLOCK = 13, 7
#: Plain words that a window of WORDS and one of BLOCK need for placeholders to stand in it; a window with fewer is taken word
#: by word. What lies outside the block holds no more than the difference, so that a block of such a window has its own.
PLAIN_WORDS, PLAIN_BLOCK = 8, 2
#: Windows of items up to this number are sent to every task (16 bytes each before hashing); more are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Windows that are hashed at once, which bounds what a very long text takes.
PART = 100_000
#: Words for units.
UNITS = frozenset("rs rupees rupee cents ha hectares hectare acres acre perches metres metre km kilometres feet days day weeks week months month years year percent".split())
#: How windows are read: word by word, with numbers and units as placeholders, with names too.
EQUAL, TYPED, NAMED = range(3)

_ENDS = re.compile(r"[.!?:;]\W*$")
_PLAIN, _NUMBER, _UNIT, _NAME = range(4)


def clean(word: str) -> str:
    """A word in lower case without characters other than letters, marks and decimal digits."""
    low = word.lower()
    if low.isalnum() and low.isascii():
        return low
    return "".join(c for c in low if (kind := unicodedata.category(c))[0] in "LM" or kind == "Nd")


def hash_of(word: str) -> int:
    """A hash of 64 bits that is the same in every process."""
    h = 0xCBF29CE484222325
    for b in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 29)


class Lexicon:
    """What is known of each word as written: hash, type, whether it has a capital, whether a sentence may end with it; kept by the worker."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.hashes: list[int] = []
        self.types: list[int] = []
        self.capital: list[bool] = []
        self.ends: list[bool] = []
        self.empty: list[bool] = []

    def __getitem__(self, word: str) -> int:
        known = self.index.get(word)
        if known is None:
            bare = clean(word)
            known = self.index[word] = len(self.hashes)
            first = next((c for c in word if c.isalpha()), "")
            self.hashes.append(hash_of(bare))
            self.types.append(_NUMBER if any(c.isdecimal() for c in bare) else _UNIT if bare in UNITS else _PLAIN)
            self.capital.append(first.isupper() and not (len(bare) > 1 and word.upper() == word))
            self.ends.append(bool(_ENDS.search(word)))
            self.empty.append(not bare)
        return known


_lexicon = Lexicon()


class Reading:
    """The words of a batch of texts in a row: hashes, types, and where each text begins and ends."""

    def __init__(self, hashes: np.ndarray, types: np.ndarray, bounds: np.ndarray):
        self.hashes, self.types, self.bounds = hashes, types, bounds


def readings(texts: list[str]) -> tuple[Reading, Reading]:
    """The texts with numbers and units typed, and with names typed too, those of several words as one."""
    if len(_lexicon.hashes) > _lexicon.most:
        _lexicon.clear()
    get, new = _lexicon.index.get, _lexicon.__getitem__
    rows = [[i if (i := get(w)) is not None else new(w) for w in t.split()] for t in texts]
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(sizes.sum()))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    take = lambda column, kind: np.array(column, dtype=kind)[flat] if len(flat) else np.zeros(0, dtype=kind)
    hashes, types, capital, ends, empty = take(_lexicon.hashes, np.uint64), take(_lexicon.types, np.int8), take(_lexicon.capital, bool), take(_lexicon.ends, bool), take(_lexicon.empty, bool)
    opens = np.ones(len(flat), dtype=bool)  # whether a sentence or text may begin with a word
    opens[1:] = ends[:-1]
    opens[starts[:-1][sizes > 0]] = True
    named = capital & ~opens & (types == _PLAIN)
    keep = ~empty
    kept = np.concatenate(([0], np.cumsum(keep)))
    hashes, types, named, bounds = hashes[keep], types[keep], named[keep], kept[starts]
    plain = Reading(hashes, types, bounds)
    if not named.any():
        return plain, Reading(hashes, types, bounds)
    inner = np.zeros(len(named), dtype=bool)  # a name after a name of the same text
    inner[1:] = named[1:] & named[:-1]
    inner[bounds[:-1][bounds[:-1] < len(named)]] = False
    lead = np.flatnonzero(~inner)
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(hashes * (np.arange(len(hashes), dtype=np.uint64) - np.repeat(lead, np.diff(np.append(lead, len(hashes)))).astype(np.uint64) + np.uint64(1)), lead)
    return plain, Reading(whole, np.where(named[lead], _NAME, types[lead]), np.concatenate(([0], np.cumsum(~inner)))[bounds])


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS, _PAIRS, _TYPES = _odd(1, WORDS), _odd(2, WORDS * WORDS).reshape(WORDS, WORDS), _odd(3, 4)


def windows(read: Reading, at: np.ndarray, size: int, least: int, how: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether it has placeholders) of the windows of so many forms that begin at given places.

    A window with fewer than `least` plain words, and every one where how is EQUAL, is hashed word by word.
    """
    spots = at[:, None] + np.arange(size)
    own, kind = read.hashes[spots], read.types[spots]
    slot = kind != _PLAIN
    with np.errstate(over="ignore"):
        if how == EQUAL:
            return (own * _POWERS[:size]).sum(axis=1, dtype=np.uint64), np.zeros(len(at), dtype=bool)
        typed = slot.any(axis=1) & ((~slot).sum(axis=1) >= least)
        slot &= typed[:, None]
        hashed = (np.where(slot, _TYPES[kind], own) * _POWERS[:size]).sum(axis=1, dtype=np.uint64)
        several = np.flatnonzero(slot.sum(axis=1) > 1)
        if len(several):
            same, held = own[several], slot[several]
            for i in range(size):
                for j in range(i + 1, size):
                    hashed[several] += ((same[:, i] == same[:, j]) & held[:, i] & held[:, j]) * _PAIRS[i, j]
    return hashed, typed


def _places(bounds: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the windows that lie whole in a text, at every step-th form of it."""
    counts = np.maximum(0, (np.diff(bounds) - size) // step + 1)
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, bounds[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * step


def _rows(id_: pa.Array, texts: list[str], size: int, step: int, least: int, hows: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """(id, how, hash) of the windows of some texts, a part at a time; those with names only where they have placeholders."""
    plain, named = readings(texts)
    for how in hows:
        read = named if how == NAMED else plain
        owners, places = _places(read.bounds, size, step)
        for start in range(0, len(places), PART):
            owner, at = owners[start : start + PART], places[start : start + PART]
            hashed, typed = windows(read, at, size, least, how)
            if how == NAMED or how == TYPED and size == WORDS:
                owner, hashed = owner[typed], hashed[typed]
            kinds = np.full(len(owner), how, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([id_.take(pa.array(owner)), pa.array(kinds), pa.array(hashed.view(np.int64))], names=["id", "how", "hash"])


def _windows_of(df: DataFrame, id_: str, text: str, size: int, step: int, least: int, hows: tuple[int, ...]) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = characters = 0
            texts = batch.column(1).to_pylist()
            for i, t in enumerate(texts):
                characters += len(t)
                # Some texts at once, but not so many that their windows fill the worker.
                if characters > 400_000 or i == len(texts) - 1:
                    yield from _rows(batch.column(0).slice(start, i + 1 - start), texts[start : i + 1], size, step, least, hows)
                    start, characters = i + 1, 0

    rows = df.where(F.col(id_).isNotNull() & F.col(text).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(read, "id long, how int, hash long")


def _met(windows: DataFrame, items: DataFrame, on: list[str], how: str, most: int) -> DataFrame:
    """The join, with the items' side sent to every task where its number of rows allows; else by shuffle, in which AQE splits a hot window."""
    return windows.join(F.broadcast(items) if items.count() <= most else items, on, how)


def leaks(documents: DataFrame, items: DataFrame, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, equal, alike) of documents (doc_id, text) and items (item_id, passage) that share a window of WORDS words or forms.

    equal is the number of windows of equal words in the text, alike that of windows equal in form with consistent placeholders,
    PLAIN_WORDS plain words or more and not word by word the same. Letter case and characters other than letters, marks and
    digits are aside; a name is a word with a capital inside a sentence, and names in a row are one. Null, empty and short texts
    and passages share nothing; repeated documents and items come out once. No items, no rows. `most` changes how windows are joined, not what is found.
    """
    spark = documents.sparkSession
    asked = cut(_windows_of(items, "item_id", "passage", BLOCK, 1, PLAIN_BLOCK, (TYPED, NAMED)).select("hash").distinct())
    # A pair of forms in a block decides nothing yet: it only says which texts are looked at window by window.
    blocks = _windows_of(documents, "doc_id", "text", BLOCK, BLOCK, PLAIN_BLOCK, (TYPED, NAMED)).select("id", "hash")
    near = cut(_met(blocks, asked, ["hash"], "left_semi", most).select(F.col("id").alias("doc_id")).distinct())
    texts = documents.select("doc_id", "text").join(near, "doc_id", "left_semi")
    hows = (EQUAL, TYPED, NAMED)
    sought = cut(_windows_of(items, "item_id", "passage", WORDS, 1, PLAIN_WORDS, hows).select(F.col("id").alias("item_id"), "how", "hash").distinct())
    pairs = _met(_windows_of(texts, "doc_id", "text", WORDS, 1, PLAIN_WORDS, hows), sought, ["how", "hash"], "inner", most)
    count = lambda how: F.count(F.when(F.col("how") == how, 1))
    found = pairs.groupBy(F.col("id").alias("doc_id"), "item_id").agg(count(EQUAL).alias("equal"), F.greatest(count(TYPED), count(NAMED)).alias("alike"))
    drop(spark, asked)
    return found


def leaked(found: DataFrame) -> DataFrame:
    """(doc_id, item_id) of passages that stand in a text word by word."""
    return found.where("equal > 0").select("doc_id", "item_id")


def reworded(found: DataFrame) -> DataFrame:
    """(doc_id, item_id, alike) of passages that stand in a text with other numbers, units or names only."""
    return found.where("equal = 0 and alike > 0").select("doc_id", "item_id", "alike")
