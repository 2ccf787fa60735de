import random

import numpy as np

from lexloom.operators import search as s


def test_dense_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8)).tolist() + [[0.0] * 8]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(100, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in s.dense(df, df.where("id % 20 = 0 and id < 60"), "id", "v", 5, per_pass=2).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["hit"]
    for q in (0, 20, 40):
        a = np.array(vectors[q]) / np.linalg.norm(vectors[q])
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-round(float(a @ (np.array(vectors[i]) / np.linalg.norm(vectors[i]))), 9), i))
        assert [got[q][k] for k in range(1, 6)] == order[:5]
    assert s.dense(df, df.limit(0), "id", "v", 5).count() == 0
    assert s.dense(df.limit(0), df.where("id = 0"), "id", "v", 5).count() == 0


def test_bm25_blocks_agree_and_edges(spark):
    rng = random.Random(1)
    words = ["fee", "act", "land", "court", "පනත", "மனு", "12a"]
    corpus = spark.createDataFrame([(f"c{i}", " ".join(rng.choices(words, k=rng.randrange(0, 12))) if i % 9 else None) for i in range(80)], "id string, text string")
    queries = spark.createDataFrame([(1, "Act, FEE!"), (2, "පනත"), (3, None), (4, "..."), (5, "absent"), (6, "fee fee act")], "query long, words string")
    one = {tuple(r) for r in s.bm25(corpus, queries, 4).collect()}
    assert one == {tuple(r) for r in s.bm25(corpus, queries, 4, per_pass=1).collect()}
    assert {q for q, *_ in one} == {1, 2, 6} and {r[1:] for r in one if r[0] == 1} == {r[1:] for r in one if r[0] == 6}
    assert s.bm25(corpus.limit(0), queries, 4).count() == 0 and s.bm25(corpus, queries.limit(0), 4).count() == 0


def test_fusion_and_recall(spark):
    one = spark.createDataFrame([(1, 10, 1, 1.0), (1, 11, 2, 0.5)], "query long, hit long, rank int, cosine double")
    two = spark.createDataFrame([(1, 11, 1, 4.0), (1, 12, 2, 2.0)], "query long, hit long, rank int, score double")
    assert [(r.hit, r.rank) for r in s.rank_fusion([one, two], 2).orderBy("rank").collect()] == [(11, 1), (10, 2)]
    assert [r.hit for r in s.weighted_fusion(one, two, 3).orderBy("rank").collect()] == [10, 11, 12]
    judged = spark.createDataFrame([(1, 2, True), (1, 1, False), (2, 1, False)], "query long, rank int, relevant boolean")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query long")
    assert tuple(s.recall(judged, queries, [1, 5]).first()) == (0.0, round(1 / 3, 6))
