"""Exact vector search, keyword search by BM25, and their fusion."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Queries searched for in one pass over the vectors; more take more passes.
QUERIES = 4096
#: Parameters of BM25.
K1, B = 1.2, 0.75
SINHALA_OR_TAMIL = r"[඀-෿஀-௿]"


def unit_rows(lists: pa.Array) -> np.ndarray:
    """Vectors as rows of length 1; one of length 0 stays 0."""
    own = np.stack([np.asarray(v, dtype=np.float64) for v in lists.to_pylist()])
    norms = np.linalg.norm(own, axis=1, keepdims=True)
    return np.divide(own, norms, out=np.zeros_like(own), where=norms > 0)


def query_blocks(queries: DataFrame, id_: str, vector: str, per_pass: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows of length 1) of the queries, a block at a time."""
    block: list[tuple[int, list[float]]] = []
    for row in queries.where(F.col(vector).isNotNull()).select(F.col(id_).cast("long"), vector).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == per_pass:
            yield np.array([q for q, _ in block]), unit_rows(pa.array([v for _, v in block]))
            block = []
    if block:
        yield np.array([q for q, _ in block]), unit_rows(pa.array([v for _, v in block]))


def dense(vectors: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, per_pass: int = QUERIES) -> DataFrame:
    """(query, hit, cosine, rank): the k nearest rows of each query by cosine, ties by id, the query's own row left out.

    The queries are a stated set, searched for in blocks of per_pass: each task multiplies its vectors with the block and keeps k
    rows a query, so that k rows a task and query are shuffled and never all pairs. Null vectors and those of length 0 are no hits.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_).cast("long"), vector)
    out = None
    for ids, matrix in query_blocks(queries, id_, vector, per_pass):
        sent = spark.sparkContext.broadcast((ids, matrix))

        def task(batches, sent=sent):
            ids, matrix = sent.value
            best_score = np.full((len(ids), 0), -np.inf)
            best_id = np.zeros((len(ids), 0), dtype=np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    own, near = unit_rows(part.column(1)), np.array(part.column(0).to_pylist(), dtype=np.int64)
                    scores = np.round(matrix @ own.T, 9)
                    scores[:, ~own.any(axis=1)] = -np.inf
                    scores[ids[:, None] == near[None, :]] = -np.inf
                    joined, joined_id = np.concatenate([best_score, scores], axis=1), np.concatenate([best_id, np.broadcast_to(near, scores.shape)], axis=1)
                    order = np.lexsort((joined_id, -joined), axis=1)[:, :k]
                    best_score, best_id = np.take_along_axis(joined, order, 1), np.take_along_axis(joined_id, order, 1)
            query = np.repeat(ids, best_score.shape[1])
            keep = best_score.ravel() > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(query[keep]), pa.array(best_id.ravel()[keep]), pa.array(best_score.ravel()[keep])], names=["query", "hit", "cosine"])

        found = rows.mapInArrow(task, "query long, hit long, cosine double")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query long, hit long, cosine double, rank int")
    window = Window.partitionBy("query").orderBy(F.desc("cosine"), "hit")
    return out.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


class Tokenizer:
    """Lower-case runs of letters, marks and decimal digits; all other characters part them."""

    def __init__(self) -> None:
        self.kept: set[str] = set(" ")
        self.parting: set[str] = set()
        self.pattern = re.compile("(?!)")

    def __call__(self, text: str) -> list[str]:
        text = text.lower()
        new = set(text) - self.kept - self.parting
        if new:
            part = {c for c in new if (kind := unicodedata.category(c))[0] not in "LM" and kind != "Nd"}
            self.kept |= new - part
            if part:
                self.parting |= part
                self.pattern = re.compile("[" + "".join(f"\\U{ord(c):08x}" for c in sorted(self.parting)) + "]+")
        return self.pattern.sub(" ", text).split()


def bm25(corpus: DataFrame, queries: DataFrame, k: int, id_: str = "id", text: str = "text", query_id: str = "query", query_text: str = "words", per_pass: int = QUERIES) -> DataFrame:
    """(query, hit, score, rank): the k best texts of each query by BM25; ties go to the smaller id, texts without a term of it are no hits.

    The queries are a stated set, asked in blocks of per_pass. One pass counts the texts that hold each of a block's terms, a second
    scores each text where it lies and keeps k a query and task, so that neither postings nor scores of all texts are shuffled.
    """
    spark = corpus.sparkSession
    read = Tokenizer()
    texts = corpus.where(F.col(text).isNotNull()).select(F.col(id_).cast("string").alias("id"), F.col(text).alias("text"))
    kind = queries.schema[query_id].dataType.simpleString()
    out, block = None, []
    for row in queries.where(F.col(query_text).isNotNull()).select(query_id, query_text).toLocalIterator():
        if words := sorted(set(read(row[1]))):
            block.append((row[0], words))
        if len(block) == per_pass:
            out, block = _scored(texts, block, k, kind) if out is None else out.union(_scored(texts, block, k, kind)), []
    if block:
        out = _scored(texts, block, k, kind) if out is None else out.union(_scored(texts, block, k, kind))
    if out is None:
        return spark.createDataFrame([], f"query {kind}, hit string, score double, rank int")
    window = Window.partitionBy("query").orderBy(F.desc("score"), "hit")
    return out.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _scored(texts: DataFrame, block: list[tuple[object, list[str]]], k: int, kind: str) -> DataFrame:
    spark = texts.sparkSession
    asking: dict[str, list[int]] = {}
    for q, (_, words) in enumerate(block):
        for w in words:
            asking.setdefault(w, []).append(q)
    sent = spark.sparkContext.broadcast(asking)

    def count(batches):
        read, known = Tokenizer(), sent.value.keys()
        found: Counter[str] = Counter()
        docs = length = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = read(t)
                docs, length = docs + 1, length + len(words)
                found.update(known & set(words))
        terms = [*found, ""]
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([*found.values(), docs], pa.int64()), pa.array([0] * len(found) + [length], pa.int64())], names=["term", "n", "length"])

    counts = {r.term: (r.n, r.length) for r in texts.select("text").mapInArrow(count, "term string, n long, length long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect()}
    docs, length = counts.pop("", (0, 0))
    mean = length / docs if docs else 1.0
    idf = spark.sparkContext.broadcast({t: math.log1p((docs - n + 0.5) / (n + 0.5)) for t, (n, _) in counts.items()})
    names = [q for q, _ in block]

    def score(batches):
        read, weight = Tokenizer(), idf.value
        asked = {w: np.array(qs) for w, qs in sent.value.items() if w in weight}
        best: list[list] = [[] for _ in names]
        least = np.full(len(names), 1e-9)  # what a text must reach to be among the best of a query so far
        for batch in batches:
            for id_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = read(t)
                flat = K1 * (1 - B + B * len(words) / mean)
                points = np.zeros(len(names))
                for w, tf in Counter(words).items():
                    if w in asked:
                        points[asked[w]] += weight[w] * tf * (K1 + 1) / (tf + flat)
                points = np.round(points, 6)
                for q in np.flatnonzero(points >= least).tolist():
                    own = best[q]
                    own.append((-float(points[q]), id_))
                    if len(own) >= 4 * k:
                        best[q] = own = heapq.nsmallest(k, own)
                        least[q] = -own[-1][0]
        rows = [(names[q], i, -p) for q, own in enumerate(best) for p, i in heapq.nsmallest(k, own)]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], names=["query", "hit", "score"])

    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    return texts.mapInArrow(score, f"query {kind}, hit string, score double")


def overlap(corpus: DataFrame, queries: DataFrame, k: int, longer: int = 0, id_: str = "id", text: str = "text", per_pass: int = QUERIES) -> DataFrame:
    """(query, hit, score, rank): the k texts that share most different words with each query, ties to the smaller id; words of `longer` characters or fewer are aside.

    Each text is looked at once, and each task keeps k a query, so that pairs of queries and texts are never shuffled.
    """
    spark, read = corpus.sparkSession, Tokenizer()
    kind = queries.schema["query"].dataType.simpleString()
    rows = corpus.where(F.col(text).isNotNull()).select(F.col(id_).cast("string").alias("id"), F.col(text).alias("text"))
    asked = queries.where(F.col("words").isNotNull()).select("query", "words").toLocalIterator()
    out = None
    for _, block in itertools.groupby(enumerate(asked), key=lambda x: x[0] // per_pass):
        asking: dict[str, list] = {}
        for _, r in block:
            for w in {w for w in read(r["words"]) if len(w) > longer}:
                asking.setdefault(w, []).append(r["query"])
        sent = spark.sparkContext.broadcast(asking)

        def task(batches, sent=sent):
            read, asking = Tokenizer(), sent.value
            best: dict[object, list[tuple[int, tuple]]] = {}
            for batch in batches:
                for own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    shared = Counter(q for w in asking.keys() & set(read(t)) for q in asking[w])
                    for q, n in shared.items():
                        heap = best.setdefault(q, [])
                        heap.append((-n, own))
                        if len(heap) > 8 * k:
                            heap[:] = heapq.nsmallest(k, heap)
            found = [(q, own, float(-n)) for q, heap in best.items() for n, own in heapq.nsmallest(k, heap)]
            yield pa.RecordBatch.from_pylist([dict(zip(("query", "hit", "score"), f, strict=True)) for f in found], schema=pa.schema([("query", pa.int64() if kind == "bigint" else pa.string()), ("hit", pa.string()), ("score", pa.float64())]))

        found = rows.mapInArrow(task, f"query {kind}, hit string, score double")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], f"query {kind}, hit string, score double, rank int")
    window = Window.partitionBy("query").orderBy(F.desc("score"), "hit")
    return out.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def text_vectors(df: DataFrame, id_: str, text: str, dimensions: int = 64) -> DataFrame:
    """(id, embedding): a text's terms counted in so many dimensions by their hashes, each count damped by its logarithm.

    It stands in for a model where none is at hand; a text without terms has a vector of zeros, which is no hit. Null texts give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, places = Tokenizer(), {}
        for batch in batches:
            out = np.zeros((batch.num_rows, dimensions), dtype=np.float64)
            for i, t in enumerate(batch.column(1).to_pylist()):
                for term, n in Counter(read(t)).items():
                    at = places.get(term)
                    if at is None:
                        if len(places) > 200_000:
                            places.clear()
                        at = places[term] = int(hashlib.md5(term.encode()).hexdigest()[:4], 16) % dimensions
                    out[i, at] += n
            rows = pa.FixedSizeListArray.from_arrays(pa.array(np.log1p(out).ravel()), dimensions).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["id", "embedding"])

    return df.where(F.col(text).isNotNull()).select(F.col(id_).cast("long").alias("id"), text).mapInArrow(run, "id long, embedding array<double>")


def rank_fusion(legs: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """(query, hit, score, rank) by the sum over the legs of 1 / (constant + rank)."""
    union = legs[0].select("query", "hit", "rank")
    for leg in legs[1:]:
        union = union.unionAll(leg.select("query", "hit", "rank"))
    fused = union.groupBy("query", "hit").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    window = Window.partitionBy("query").orderBy(F.desc("score"), "hit")
    return fused.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def weighted_fusion(dense_hits: DataFrame, keyword_hits: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(query, hit, score, rank) by weight * dense + (1 - weight) * keyword score, each leg scaled by its best of the query."""
    legs = []
    for leg, column, part in ((dense_hits, "cosine", weight), (keyword_hits, "score", 1 - weight)):
        best = F.max(column).over(Window.partitionBy("query"))
        legs.append(leg.select("query", "hit", (F.col(column) / best * part).alias("part")))
    fused = legs[0].unionAll(legs[1]).groupBy("query", "hit").agg(F.round(F.sum("part"), 6).alias("score"))
    window = Window.partitionBy("query").orderBy(F.desc("score"), "hit")
    return fused.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def recall(judged: DataFrame, queries: DataFrame, at: list[int]) -> DataFrame:
    """One row of recall at each depth: the share of queries (query) whose first relevant hit (query, rank, relevant) is no deeper."""
    first = judged.where("relevant").groupBy("query").agg(F.min("rank").alias("first"))
    every = queries.select("query").distinct().join(first, "query", "left")
    return every.agg(*[F.round(F.avg(F.coalesce((F.col("first") <= n).cast("double"), F.lit(0.0))), 6).alias(f"recall_{n}") for n in at])


def best_of_groups(vectors: DataFrame, queries: DataFrame, id_: str, vector: str, group: str, per_pass: int = QUERIES) -> DataFrame:
    """(query, group, hit, cosine, rank): for each query the nearest row of every group, ties by id, and the group's place among them.

    Each block of rows is multiplied with a block of queries and leaves one row a query and group that it holds, so that the best
    of a group is found however deep it lies among all rows. The query's own row is left out; a null group is a group.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[group].dataType
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_).cast("long"), vector, group)
    schema = StructType().add("query", "long").add("group", kind).add("hit", "long").add("cosine", "double")
    out = None
    for ids, matrix in query_blocks(queries, id_, vector, per_pass):
        sent = spark.sparkContext.broadcast((ids, matrix))

        def task(batches, sent=sent):
            ids, matrix = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096).sort_by([(batch.schema.names[2], "ascending"), (batch.schema.names[0], "ascending")])
                    own, near = unit_rows(part.column(1)), np.array(part.column(0).to_pylist(), dtype=np.int64)
                    groups = part.column(2).to_pylist()
                    scores = np.round(matrix @ own.T, 9)
                    scores[:, ~own.any(axis=1)] = -np.inf
                    scores[ids[:, None] == near[None, :]] = -np.inf
                    starts = [i for i, g in enumerate(groups) if not i or g != groups[i - 1]]
                    for a, b in zip(starts, [*starts[1:], len(groups)], strict=True):
                        best = scores[:, a:b].argmax(axis=1)  # the first of equal ones, which is the smallest id
                        score = scores[np.arange(len(ids)), a + best]
                        keep = score > -np.inf
                        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), part.column(2).take(pa.array(np.full(int(keep.sum()), a))), pa.array(near[a + best][keep]), pa.array(score[keep])], names=["query", "group", "hit", "cosine"])

        found = rows.mapInArrow(task, schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = out.groupBy("query", "group").agg(F.max(F.struct("cosine", (-F.col("hit")).alias("h"))).alias("b")).select("query", "group", (-F.col("b.h")).alias("hit"), F.col("b.cosine").alias("cosine"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "hit")))
