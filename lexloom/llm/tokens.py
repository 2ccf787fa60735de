"""Encoding of whole texts with a public byte-level BPE, with reuse of content-defined chunks.

A text is cut where a rolling hash of the bytes before a blank says so, and only at blanks that begin a word: there the
tokenizer's own splitting pattern begins a piece too, so the ids of the chunks in a row are the ids of the text. Chunks recur
across documents; each worker encodes one once and keeps its ids. Where a text has no such place for a long stretch, it is
cut at a fixed length, which may be inside a word, and every join made like that is repaired: from the last piece before the cut
on the text is split again, in a growing window, until a piece begins where one began in the chunk after the cut. From there on
the ids of that chunk are those of the whole text; what lies between is encoded again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files of the public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public splitting pattern of this family of byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank is a landmark if the hash of the bytes before it is 0 modulo this.
MODULUS = 3
#: Bytes of the rolling hash, and the odd number by which it moves on.
WIDTH, STEP = 6, 0x9E3779B1
#: Bytes from which on a chunk without a landmark is cut anyway, every so many characters, and repaired.
LONGEST = 1 << 16
#: Bytes of chunks and ids that a worker keeps; the memory is emptied when full, which costs time and loses nothing.
KEPT_BYTES = 48_000_000

_encoders: dict[str, object] = {}


class ChunkEncoder:
    """Encodes texts given as one buffer of UTF-8 with offsets."""

    def __init__(self, folder: str, name: str, kept_bytes: int = KEPT_BYTES, modulus: int = MODULUS, longest: int = LONGEST):
        import regex
        import tiktoken

        self.piece = regex.compile(PATTERN)
        lines = (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
        self.plain = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[bytes, bytes] = {}
        self.room = self.kept_bytes = kept_bytes
        self.modulus, self.longest = modulus, longest
        self.encoded = self.asked = self.repaired = 0

    def ids(self, chunk: bytes) -> bytes:
        return np.array(self.plain.encode_ordinary(chunk.decode("utf-8")), dtype=np.int32).tobytes()

    def landmarks(self, data: np.ndarray) -> np.ndarray:
        """Positions of the blanks at which a chunk may begin."""
        blanks = np.flatnonzero(data == 32)
        blanks = blanks[(blanks >= WIDTH) & (blanks + 1 < len(data))]
        after = data[blanks + 1]
        # A printable ASCII character, or the first byte of a script in which no character is white space.
        word = ((after > 32) & (after < 127)) | ((after >= 0xC3) & (after != 0xE1) & (after != 0xE2) & (after != 0xE3))
        blanks = blanks[word]
        rolled = np.zeros(len(blanks), dtype=np.uint32)
        for back in range(1, WIDTH + 1):
            rolled = rolled * np.uint32(STEP) + data[blanks - back]
        rolled ^= rolled >> np.uint32(15)
        return blanks[rolled % np.uint32(self.modulus) == 0]

    def lookup(self, chunk: bytes) -> bytes:
        self.asked += 1
        ids = self.kept.get(chunk)
        if ids is None:
            ids = self.ids(chunk)
            self.encoded += 1
            if len(chunk) < 512:
                self.room -= len(chunk) + len(ids) + 200
                if self.room < 0:
                    self.kept.clear()
                    self.room = self.kept_bytes
                self.kept[chunk] = ids
        return ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's ids."""
        buffer = data.tobytes()
        marks = self.landmarks(data)
        first = np.searchsorted(marks, offsets[:-1], side="right").tolist()
        last = np.maximum(np.searchsorted(marks, offsets[1:] - 1, side="left"), first).tolist()  # a text's last blank begins no word
        marks, bounds = marks.tolist(), offsets.tolist()
        parts: list[bytes] = []
        sizes = np.zeros(len(bounds), dtype=np.int64)
        kept, lookup, longest = self.kept, self.lookup, self.longest
        for i, (a, b) in enumerate(zip(first, last, strict=True)):
            start, end = bounds[i], bounds[i + 1]
            if start == end:
                continue
            own = marks[a:b]
            size = 0
            for x, y in zip([start, *own], [*own, end], strict=True):
                chunk = buffer[x:y]
                ids = kept.get(chunk)
                if ids is None:
                    ids = lookup(chunk) if y - x <= longest else self.long_ids(chunk.decode("utf-8"))
                parts.append(ids)
                size += len(ids)
            sizes[i + 1] = size >> 2
        return np.frombuffer(b"".join(parts), dtype=np.int32), np.cumsum(sizes)

    def starts(self, text: str, at: int, ends: bool) -> list[int]:
        """Where the pieces of a text begin that itself begins at a place; with its end if nothing follows it.

        If something does, a piece that begins at the last character may be one with an apostrophe before it: it is left out.
        """
        begun = [at + m.start() for m in self.piece.finditer(text)]
        return [*begun, at + len(text)] if ends else [p for p in begun if p == at or p <= at + len(text) - 2]

    def of_pieces(self, text: str, starts: list[int], end: int) -> bytes:
        """The ids of pieces one by one, for white space at the end of a part would be split otherwise than within the text."""
        return b"".join(self.ids(text[a:b].encode()) for a, b in zip(starts, [*starts, end][1:], strict=True))

    def cuts(self, text: str) -> list[bytes]:
        """The ids of the parts of a text cut at the fixed length, as they are before any repair."""
        return [self.ids(text[i : i + self.longest].encode()) for i in range(0, len(text), self.longest)]

    def long_ids(self, text: str) -> bytes:
        """The ids of a text that begins where a piece does and has no other place known to be one: forced cuts, repaired."""
        out: list[bytes] = []
        begin, cut = 0, self.longest  # the part not yet given out begins with a piece, and ends at the cut
        ids = self.ids(text[:cut].encode())
        size = self.longest
        while cut < len(text):
            after = text[cut : cut + size]
            ids_after, begun = self.ids(after.encode()), self.starts(after, cut, True)
            among = set(begun)
            # All pieces before the cut are those of the whole text, but for the last, which may go on behind it.
            last = self.starts(text[begin:cut], begin, False)[-1]
            head = len(ids) - len(self.ids(text[last:cut].encode()))
            out.append(ids[:head])
            end, width, met = cut + len(after), 64, None
            while met is None:
                window = min(end, cut + width)
                split = self.starts(text[last:window], last, window == len(text))
                met = next((p for p in split if p >= cut and p in among), None)
                if window == end:
                    break
                width *= 2
            self.repaired += 1
            if met is None:
                # One piece fills the part: it is put together with the next, which is twice as long, so that all is split a few times at most.
                ids, begin, size = self.ids(text[last:end].encode()), last, 2 * size
            else:
                out.append(self.of_pieces(text, [p for p in split if p < met], met))
                ids, begin, size = ids_after[len(self.of_pieces(text, [p for p in begun if p < met], met)) :], met, self.longest
            cut = end
        return b"".join([*out, ids])


def encoder(folder: str, name: str) -> ChunkEncoder:
    """The worker's own encoder, kept from task to task."""
    if (folder, name) not in _encoders:
        _encoders[folder, name] = ChunkEncoder(folder, name)
    return _encoders[folder, name]


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of every row, without special tokens; a null or an empty text gives an empty list, blanks have their own ids.

    Repeated keys and texts come out each; texts of any length are encoded whole; other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, tokenizer)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] if len(offsets) else 0 : offsets[-1] if len(offsets) else 0]
            ids, ends = own.encode(data, offsets - offsets[0] if len(offsets) else np.zeros(1, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(ids, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}`", f"coalesce(`{text}`, '') AS text").mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
