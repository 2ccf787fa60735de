"""Languages of records and of their segments by the nearest centroid of n-gram vectors.

A segment is a vector of TF-IDF weights of hashed letter trigrams, of length 1. A bounded sample of labelled records is
clustered by cosine; each cluster takes the language that most of its segments are labelled with, so that a language has a
centroid for each of its scripts and kinds of text, and wrong labels are outvoted. A segment takes the language of the nearest
centroid, or none if all are too far.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.survivors import has_content, language_label

#: Labelled records from which the centroids are fitted, those with the smallest hashes of their ids; segments used at most.
SAMPLE_ROWS, SAMPLE_SEGMENTS = 4_000, 6_000
#: Dimensions of the hashed n-grams, clusters, rounds of clustering.
DIMENSIONS, CLUSTERS, ROUNDS = 4096, 20, 12
#: A segment whose nearest centroid has a smaller cosine has no language.
LEAST_COSINE = 0.12
#: Words in brackets are borrowed; sentences end at these, and parts of a text lie between these signs.
BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
PARTS = re.compile(r"(?<=[.!?])[\"”’']*\s+|\s+[|/—–]+\s+|\s*[\n\r]+\s*")
NOT_LETTERS = re.compile(r"[\W\d_]+")
MARKS = re.compile(r"[^\w඀-෿஀-௿‍]+|[\d_]+")


def segments(title: str | None, description: str | None) -> list[str]:
    """Whole sentences of a record; one that has no letters outside brackets is none."""
    out = []
    for text in (title, description):
        if text:
            out += [s for s in PARTS.split(BRACKETS.sub(" ", text)) if s and not NOT_LETTERS.fullmatch(s)]
    return out


def grams(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, dimension, count) of the hashed trigrams of each text, sorted by text and dimension."""
    joined = "\0".join(" " + MARKS.sub(" ", t.lower()) + " " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) < 3:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    owner = np.cumsum(codes == 0)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    use = (a != 0) & (c != 0) & (b != 0) & (b != 32)
    hashed = (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    keys = owner[1:-1][use] * dimensions + (hashed[use] >> np.uint32(7)) % np.uint32(dimensions)
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(keys)))
    return keys[first] // dimensions, keys[first] % dimensions, counts


@dataclass
class Centroids:
    idf: np.ndarray
    vectors: np.ndarray  # dimensions x clusters, each of length 1
    languages: list[str]  # of each cluster

    def cosines(self, texts: list[str]) -> np.ndarray:
        owner, dimension, count = grams(texts, len(self.idf))
        out = np.zeros((len(texts), self.vectors.shape[1]), dtype=np.float32)
        if len(owner):
            weight = ((1 + np.log(count)) * self.idf[dimension]).astype(np.float32)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            norm = np.sqrt(np.add.reduceat(weight * weight, starts))
            for k in range(self.vectors.shape[1]):
                out[owner[starts], k] = np.add.reduceat(weight * self.vectors[dimension, k], starts) / norm
        return out

    def classify(self, texts: list[str], least: float = LEAST_COSINE) -> list[tuple[str | None, float]]:
        """(language or None, confidence) of each text; the confidence is the nearest language's share of the two nearest."""
        if not texts or not self.languages:
            return [(None, 0.0)] * len(texts)
        cosines = self.cosines(texts)
        names = sorted(set(self.languages))
        own = np.array(self.languages)
        best = np.stack([cosines[:, own == n].max(axis=1) for n in names], axis=1)
        ranked = np.sort(best, axis=1)
        nearest, top = best.argmax(axis=1), ranked[:, -1]
        second = ranked[:, -2] if len(names) > 1 else np.zeros(len(texts))
        sure = top**2 / np.maximum(top**2 + second**2, 1e-9)
        return [(names[n], round(float(s), 4)) if t >= least else (None, 0.0) for n, t, s in zip(nearest, top, sure, strict=True)]


def fit(sample: list[tuple[str, str]], dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> Centroids:
    """Centroids from (segment, label) pairs; no pairs give no centroids, and then nothing has a language."""
    texts = [t for t, _ in sample]
    owner, dimension, count = grams(texts, dimensions)
    spread = np.bincount(dimension, minlength=dimensions)
    idf = np.log((1 + len(texts)) / (1 + spread)).astype(np.float32) + np.float32(0.1)
    matrix = np.zeros((len(texts), dimensions), dtype=np.float32)
    matrix[owner, dimension] = (1 + np.log(count)) * idf[dimension]
    norms = np.linalg.norm(matrix, axis=1)
    keep = np.flatnonzero(norms > 0)
    matrix = matrix[keep] / norms[keep, None]
    labels = np.array([sample[i][1] for i in keep], dtype=object)
    if not len(matrix):
        return Centroids(idf, np.zeros((dimensions, 0), dtype=np.float32), [])
    # Each start lies farthest from those before it, so that a rare script or kind of text has its own.
    starts = [int((matrix @ matrix.mean(axis=0)).argmax())]
    nearest = matrix @ matrix[starts[0]]
    while len(starts) < min(clusters, len(matrix)):
        starts.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, matrix @ matrix[starts[-1]])
    vectors = matrix[starts].T.copy()
    for _ in range(rounds):
        member = (matrix @ vectors).argmax(axis=1)
        for k in range(vectors.shape[1]):
            own = matrix[member == k]
            if len(own):
                mean = own.mean(axis=0)
                vectors[:, k] = mean / max(float(np.linalg.norm(mean)), 1e-9)
    member = (matrix @ vectors).argmax(axis=1)
    languages, used = [], []
    for k in range(vectors.shape[1]):
        names, votes = np.unique(labels[member == k].astype(str), return_counts=True)
        # A handful of segments proves nothing, and a cluster of no clear language would only blur the others.
        if votes.sum() >= max(3, len(matrix) // 2000) and votes.max() > 0.5 * votes.sum():
            languages.append(str(names[votes.argmax()]))
            used.append(k)
    return Centroids(idf, np.ascontiguousarray(vectors[:, used]), languages)


def _records(listings: DataFrame) -> DataFrame:
    title = F.when(has_content(F.col("title")), F.col("title"))
    return listings.select("id", "language", language_label(F.col("language")).alias("label"), title.alias("title"), F.get_json_object("listing", "$.description").alias("description"))


def fitted(listings: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_SEGMENTS) -> Centroids:
    """Centroids from the labelled rows whose ids have the smallest hashes, `rows` of them and at most `most` of their segments."""
    labelled = _records(listings).where("label is not null")
    # A share by hash comes first, with room to spare, so that what the driver sees doesn't grow with the table.
    share = min(1.0, 4.0 * rows / max(1, labelled.count()))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    chosen = labelled.where(place < int(share * (1 << 30))).orderBy(place, "id").limit(rows).select("title", "description", "label").collect()
    pairs = [(s, r.label) for r in chosen for s in segments(r.title, r.description)]
    return fit(pairs[:: -(-len(pairs) // most)] if len(pairs) > most else pairs)


def languages_of(listings: DataFrame, centroids: Centroids | None = None) -> DataFrame:
    """(id, language, label, languages, segments) of every listing: the languages of its whole sentences, in order, and each segment.

    language is the label as it stands and label what it names. segments has text, language and confidence; a segment too far
    from every centroid has none. A record without sentences (nulls, blanks, stand-ins, broken JSON) has no languages. Rows that
    repeat an id come out each.
    """
    model = centroids or fitted(listings)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                cut = [segments(t, d) for t, d in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]
                flat = model.classify([s for own in cut for s in own])
                told, i = [], 0
                for own in cut:
                    told.append([{"text": s, "language": n, "confidence": c} for s, (n, c) in zip(own, flat[i : i + len(own)], strict=True)])
                    i += len(own)
                named = [sorted({s["language"] for s in own if s["language"]}) for own in told]
                kind = pa.list_(pa.struct([("text", pa.string()), ("language", pa.string()), ("confidence", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(named, pa.list_(pa.string())), pa.array(told, kind)], names=["id", "language", "label", "languages", "segments"])

    return _records(listings).mapInArrow(classify, "id long, language string, label string, languages array<string>, segments array<struct<text string, language string, confidence double>>")


def wrong_labels(told: DataFrame) -> DataFrame:
    """(id, languages) of the records whose label isn't exactly their one language."""
    return told.where("size(languages) > 0 and not (size(languages) = 1 and label <=> languages[0])").select("id", F.array_join("languages", "+").alias("languages"))
