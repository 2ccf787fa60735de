"""Queries of vector and keyword search; the query set is every row whose id is divisible by 20."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.ids import vector_id
from lexloom.functions.keys import plain_label
from lexloom.operators import search as s
from lexloom.operators.filters import LawFilter
from lexloom.tables import table


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    return s.dense(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 10).select("query", "hit", "rank", F.round("cosine", 6).alias("cosine"))


def cosine_within_label(spark: SparkSession, folder: str) -> DataFrame:
    """With a scalar filter on the rows searched."""
    v = _vectors(spark, folder)
    return s.dense(v.where("label in (1, 3, 5)"), v.where("vec_id % 20 = 0"), "vec_id", "embedding", 5).select("query", "hit", "rank")


def topk_one_per_group(spark: SparkSession, folder: str) -> DataFrame:
    """The best row of every label for each query, however deep it lies."""
    v = _vectors(spark, folder)
    return s.best_of_groups(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", "label").select("query", "group", "hit", "rank")


def label_recall(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    queries = v.where("vec_id % 20 = 0")
    hits = s.dense(v, queries, "vec_id", "embedding", 10)
    of = v.select(F.col("vec_id").alias("hit"), F.col("label").alias("of_hit"))
    asked = queries.select(F.col("vec_id").alias("query"), "label")
    judged = hits.join(of, "hit").join(asked, "query").select("query", "rank", (F.col("label") == F.col("of_hit")).alias("relevant"))
    return s.recall(judged, asked, [1, 5, 10])


def _keyword(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """The questions of the evaluation items as queries against the chunks, by their number in the order of id."""
    chunks = table(spark, folder, "chunks").select("id", F.concat_ws("\n\n", "crumb", "text").alias("text"))
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("query"), F.col("question").alias("words"))
    return s.bm25(chunks, items, k)


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _keyword(spark, folder, 10)


def _legs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The 30 best chunks of each question by vectors of hashed terms, and by keywords, both under the chunk's number as a vector.

    A question in Sinhala or Tamil script has no keyword leg.
    """
    chunks = table(spark, folder, "chunks").select("id", vector_id(F.col("id")).alias("n"), F.concat_ws("\n\n", "crumb", "text").alias("text"))
    items = table(spark, folder, "eval_items").where("question is not null").select(F.col("item_id").alias("query"), F.col("question").alias("words"))
    near = s.dense(s.text_vectors(chunks, "n", "text"), s.text_vectors(items, "query", "words"), "id", "embedding", 30)
    keyword = s.bm25(chunks, items.where(~F.col("words").rlike(s.SINHALA_OR_TAMIL)), 30)
    return near, keyword.withColumn("hit", vector_id(F.col("hit")))


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors and keywords fused by reciprocal ranks."""
    return s.rank_fusion(list(_legs(spark, folder)), 10)


def weighted_fusion(spark: SparkSession, folder: str) -> DataFrame:
    near, keyword = _legs(spark, folder)
    return s.weighted_fusion(near, keyword, 10)


def filtered_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """One chunk a document, of laws alone, from the fused hits: the filter goes before the search, the grouping behind it."""
    wanted = table(spark, folder, "docs").where(LawFilter(only="laws", year_from=1950).column(F.col("doc_key"), F.col("kind"), F.col("doc_year"))).select("doc_key")
    chunks = table(spark, folder, "chunks").join(wanted, "doc_key", "left_semi").select("id", "doc_key", F.concat_ws("\n\n", "crumb", "text").alias("text"))
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("query"), F.col("question").alias("words"))
    hits = s.bm25(chunks.select("id", "text"), items, 30)
    best = hits.join(chunks.select(F.col("id").alias("hit"), "doc_key"), "hit").groupBy("query", "doc_key").agg(F.min(F.struct("rank", "hit")).alias("b"))
    return best.select("query", "doc_key", F.col("b.hit").alias("hit"), F.col("b.rank").alias("rank"))


def question_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How often the first hits of a question are of the item's document and label, by keywords."""
    items = table(spark, folder, "eval_items").where("question is not null")
    asked = items.select(F.col("item_id").alias("query"), "doc_key", plain_label(F.col("label")).alias("label"))
    named = table(spark, folder, "chunks").select(F.col("id").alias("hit"), F.col("doc_key").alias("of_doc"), F.regexp_extract("crumb", r"section (\S+)", 1).alias("of_label"))
    hits = _keyword(spark, folder, 10).join(named, "hit").join(asked, "query")
    judged = hits.select("query", "rank", ((F.col("doc_key") == F.col("of_doc")) & (F.lower("of_label") == F.col("label"))).alias("relevant"))
    return s.recall(judged, asked, [1, 5, 10])


def script_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Which leg a question may use: one in Sinhala or Tamil script is searched by vectors only."""
    items = table(spark, folder, "eval_items")
    return items.select("item_id", F.when(F.col("question").rlike(s.SINHALA_OR_TAMIL), "dense").otherwise("hybrid").alias("mode"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cosine_topk": cosine_topk,
    "cosine_within_label": cosine_within_label,
    "topk_one_per_group": topk_one_per_group,
    "label_recall": label_recall,
    "bm25_topk": bm25_topk,
    "rrf_fusion": rrf_fusion,
    "weighted_fusion": weighted_fusion,
    "filtered_fusion": filtered_fusion,
    "question_recall": question_recall,
    "script_guard": script_guard,
}

NEAR = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT q.vec_id AS query, v.vec_id AS hit, v.label, round(list_cosine_similarity(q.e, v.e), 9) AS cosine FROM v q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, hit) AS rank FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, hit) AS rank FROM c WHERE label < 5)"""

KEYWORD = r"""
d AS (SELECT id, list_filter(string_split(lower(regexp_replace(concat_ws(E'\n\n', crumb, text), '[^\p{L}\p{M}\p{Nd}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM chunks),
q AS (SELECT DISTINCT item_id AS query, unnest(list_filter(string_split(lower(regexp_replace(question, '[^\p{L}\p{M}\p{Nd}]+', ' ', 'g')), ' '), lambda x: x <> '')) AS term FROM eval_items),
z AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
i AS (SELECT id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM i GROUP BY term),
h AS (SELECT q.query, i.id AS hit, round(sum(ln(1 + (z.docs - df.df + 0.5) / (df.df + 0.5)) * i.tf * 2.2 / (i.tf + 1.2 * (0.25 + 0.75 * i.n / z.mean))), 6) AS score FROM q JOIN i ON i.term = q.term JOIN df ON df.term = q.term, z GROUP BY q.query, i.id),
kw AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, hit) AS rank FROM h)"""
LEGS = KEYWORD + r""",
nq AS (SELECT item_id, question FROM eval_items WHERE question IS NOT NULL),
kr AS (SELECT kw.query, ('0x' || replace(kw.hit, '-', '')[1:12])::BIGINT + (1::BIGINT << 50) AS hit, kw.score, kw.rank FROM kw JOIN nq ON nq.item_id = kw.query WHERE NOT regexp_matches(nq.question, '[\x{0D80}-\x{0DFF}\x{0B80}-\x{0BFF}]')),
qt AS (SELECT item_id AS query, unnest(list_filter(string_split(lower(regexp_replace(question, '[^\p{L}\p{M}\p{Nd}]+', ' ', 'g')), ' '), lambda x: x <> '')) AS term FROM eval_items),
vq AS (SELECT query, ('0x' || md5(term)[1:4])::BIGINT % 64 AS dim, ln(1 + count(*)) AS x FROM qt GROUP BY ALL),
vd AS (SELECT id, ('0x' || md5(term)[1:4])::BIGINT % 64 AS dim, ln(1 + sum(tf)) AS x FROM i GROUP BY ALL),
lq AS (SELECT query, sqrt(sum(x * x)) AS l FROM vq GROUP BY query), ld AS (SELECT id, sqrt(sum(x * x)) AS l FROM vd GROUP BY id),
cs AS (SELECT vq.query, vd.id, round(sum(vq.x * vd.x) / any_value(lq.l) / any_value(ld.l), 9) AS cosine FROM vq JOIN vd ON vd.dim = vq.dim JOIN lq ON lq.query = vq.query JOIN ld ON ld.id = vd.id GROUP BY vq.query, vd.id),
nr AS (SELECT query, ('0x' || replace(id, '-', '')[1:12])::BIGINT + (1::BIGINT << 50) AS hit, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, ('0x' || replace(id, '-', '')[1:12])::BIGINT) AS rank FROM cs)"""

ORACLE: dict[str, str] = {
    "cosine_topk": f"WITH {NEAR} SELECT query, hit, rank, round(cosine, 6) AS cosine FROM r WHERE rank <= 10",
    "cosine_within_label": f"WITH {NEAR}, x AS (SELECT query, hit, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, hit) AS rank FROM c WHERE label IN (1, 3, 5)) SELECT * FROM x WHERE rank <= 5",
    "topk_one_per_group": f'WITH {NEAR}, g AS (SELECT query, label AS "group", arg_min(hit, rank) AS hit, min(rank) AS first FROM r GROUP BY query, label) SELECT query, "group", hit, row_number() OVER (PARTITION BY query ORDER BY first) AS rank FROM g',
    "label_recall": f"""WITH {NEAR}, q AS (SELECT vec_id AS query, label FROM v WHERE vec_id % 20 = 0), k AS (SELECT q.query, min(r.rank) AS first FROM q LEFT JOIN r ON r.query = q.query AND r.label = q.label AND r.rank <= 10 GROUP BY q.query)
SELECT round(avg(coalesce((first <= 1)::INT, 0)), 6) AS recall_1, round(avg(coalesce((first <= 5)::INT, 0)), 6) AS recall_5, round(avg(coalesce((first <= 10)::INT, 0)), 6) AS recall_10 FROM k""",
    "bm25_topk": r"""
WITH d AS (SELECT id, list_filter(string_split(lower(regexp_replace(concat_ws(E'\n\n', crumb, text), '[^\p{L}\p{M}\p{Nd}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM chunks),
q AS (SELECT DISTINCT item_id AS query, unnest(list_filter(string_split(lower(regexp_replace(question, '[^\p{L}\p{M}\p{Nd}]+', ' ', 'g')), ' '), lambda x: x <> '')) AS term FROM eval_items),
z AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
i AS (SELECT id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY id, term),
f AS (SELECT term, count(*) AS df FROM i GROUP BY term),
h AS (SELECT q.query, i.id AS hit, round(sum(ln(1 + (z.docs - f.df + 0.5) / (f.df + 0.5)) * i.tf * 2.2 / (i.tf + 1.2 * (0.25 + 0.75 * i.n / z.mean))), 6) AS score FROM q JOIN i ON i.term = q.term JOIN f ON f.term = q.term, z GROUP BY q.query, i.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, hit) AS rank FROM h)
SELECT query, hit, score, rank FROM r WHERE rank <= 10""",
    "rrf_fusion": f"""WITH {LEGS}, u AS (SELECT query, hit, rank FROM nr WHERE rank <= 30 UNION ALL SELECT query, hit, rank FROM kr WHERE rank <= 30),
x AS (SELECT query, hit, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY query, hit), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, hit) AS rank FROM x) SELECT * FROM k WHERE rank <= 10""",
    "weighted_fusion": f"""WITH {LEGS}, u AS (SELECT query, hit, cosine / max(cosine) OVER (PARTITION BY query) * 0.7::DOUBLE AS part FROM nr WHERE rank <= 30 UNION ALL SELECT query, hit, score / max(score) OVER (PARTITION BY query) * (1 - 0.7::DOUBLE) FROM kr WHERE rank <= 30),
x AS (SELECT query, hit, round(sum(part), 6) AS score FROM u GROUP BY query, hit), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, hit) AS rank FROM x) SELECT * FROM k WHERE rank <= 10""",
    "filtered_fusion": f"""WITH {KEYWORD.replace('FROM chunks)', "FROM chunks WHERE doc_key IN (SELECT doc_key FROM docs WHERE doc_year >= 1950 AND regexp_matches(doc_key, '^(act:|law:|ordinance:|cap:|cap1956:|amendment:|constitution)')))")}
SELECT query, doc_key, arg_min(hit, rank) AS hit, min(rank) AS rank FROM kw JOIN chunks c ON c.id = hit WHERE rank <= 30 GROUP BY query, doc_key""",
    "question_recall": f"""WITH {KEYWORD}, f AS (SELECT e.item_id, min(rank) AS first FROM eval_items e JOIN kw ON kw.query = e.item_id AND rank <= 10 JOIN chunks c ON c.id = kw.hit AND c.doc_key = e.doc_key AND lower(regexp_extract(c.crumb, 'section (\\S+)', 1)) = lower(trim(e.label)) GROUP BY 1)
SELECT round(avg(coalesce(CAST(first <= 1 AS INT), 0)), 6) AS recall_1, round(avg(coalesce(CAST(first <= 5 AS INT), 0)), 6) AS recall_5, round(avg(coalesce(CAST(first <= 10 AS INT), 0)), 6) AS recall_10 FROM eval_items e LEFT JOIN f USING (item_id) WHERE question IS NOT NULL""",
    "script_guard": r"SELECT item_id, CASE WHEN regexp_matches(question, '[\x{0D80}-\x{0DFF}\x{0B80}-\x{0BFF}]') THEN 'dense' ELSE 'hybrid' END AS mode FROM eval_items",
}
