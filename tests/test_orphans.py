import random
from datetime import datetime, timedelta

from lexloom.operators.orphans import family_and_number, lifetimes, orphans, orphans_by_month, runs
from pyspark.sql import functions as F

LINK = "id long, src_doc string, kind string, dst_doc string, dst_label string, dst_chunk string, made_at timestamp_ntz, rows string, slot string"
DOC = "doc_key string, built_at timestamp_ntz, removed_at timestamp_ntz, title string"
CHUNK = "id string, doc_key string, label string, built_at timestamp_ntz, removed_at timestamp_ntz, text string"
T = datetime(2024, 1, 1)


def brute(links, docs, chunks):
    def plain(k):
        return None if k is None else k.lower().replace(" ", "").replace(":0", ":")

    def judge(parents, at):
        if not parents:
            return "missing"
        known = [(b, r) for b, r in parents if b]
        if at and any(b <= at and (r is None or r > at) for b, r in known):
            return None
        return "late" if at and any(b > at for b, _ in known) else "deleted"

    out = set()
    for i, _, _, d, lab, c, at, *_ in links:
        of_doc = [(b, r) for k, b, r, _ in docs if plain(k) == plain(d) and d]
        found = {"dst_doc": judge(of_doc, at)}
        if c is not None:
            found["dst_chunk"] = judge([(b, r) for j, _, _, b, r, _ in chunks if j == c], at)
        if lab is not None and of_doc:
            found["dst_label"] = judge([(b, r) for _, k, x, b, r, _ in chunks if k == plain(d) and x and x.strip().lower() == lab.strip().lower()], at)
        out |= {(i, f, r) for f, r in found.items() if r}
    return out


def frames(spark, links, docs, chunks):
    return spark.createDataFrame(links, LINK), spark.createDataFrame(docs, DOC), spark.createDataFrame(chunks, CHUNK)


def test_against_brute_force(spark):
    rng = random.Random(7)
    day = lambda: T + timedelta(days=rng.randrange(30))
    keys = [f"act:{n}/2001" for n in (1, 2, 3, 5, 9)] + ["constitution", "cap:12"]
    docs = [(k, day() if rng.random() < 0.9 else None, day() if rng.random() < 0.4 else None, "t") for k in keys[:5]]
    chunks = [(f"{n:08x}-0000-5000-8000-{n:012x}", rng.choice(keys), rng.choice(["1", "12A", " 12a", None, "Schedule"]), day(), day() if rng.random() < 0.4 else None, "x") for n in range(40)]
    links = []
    for i in range(400):
        d = rng.choice([*keys, "Act: 01/2001", "act:7/2001", "cap:012", None])
        c = rng.choice([None, rng.choice(chunks)[0], "ffffffff-0000-5000-8000-ffffffffffff", "odd"])
        links.append((i, "s", rng.choice(["cites", None]), d, rng.choice([None, "1", "12A ", "99", "schedule"]), c, day() if rng.random() < 0.95 else None, "r", "s"))
    links += links[:5]
    got = {(r.id, r.field, r.reason) for r in orphans(*frames(spark, links, docs, chunks)).collect()}
    assert got == brute(links, docs, chunks)


def test_each_row_once_and_hot_key(spark):
    links = [(i, "s", "cites", "act:4/2001", None, None, T, "r", "s") for i in range(3000)]
    out = orphans(*frames(spark, links, [("act:1/2001", T, None, "t")], []))
    assert out.count() == 3000 and {r.reason for r in out.select("reason").distinct().collect()} == {"missing"}
    assert orphans_by_month(out).collect()[0].orphans == 3000


def test_empty_tables(spark):
    assert orphans(*frames(spark, [], [], [])).count() == 0


def test_keys_split_both_ways(spark):
    keys = ["act:9/2023", "act:10/2023", "gazette:1001/04", "gazette:1001/40", "cap:24", "cap1956:24", "constitution", "x0", "007", "", "a1b2", "67b2a37c-03fd-5fef-a2ae-a3c247ce6352", "67b2a37c-03fd-5fef-a2ae-a3c247ce6353"]
    family, number = family_and_number(F.col("k"))
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", family.alias("f"), number.alias("n")).collect()
    assert len({(r.f, r.n) for r in rows}) == len(keys)
    by = {r.k: r for r in rows}
    assert by["act:9/2023"].f == by["act:10/2023"].f and (by["act:9/2023"].n, by["act:10/2023"].n) == (9, 10)


def test_lifetimes_of_a_hot_key_are_those_of_any(spark):
    rng = random.Random(4)
    rows = [("f", "x", n % 3, T + timedelta(days=rng.randrange(200)), T + timedelta(days=rng.randrange(230)) if rng.random() < 0.9 else None) for n in range(300)]
    df = spark.createDataFrame(rows, "field string, family string, n long, built_at timestamp_ntz, removed_at timestamp_ntz")
    plain = lambda out: {(r.n, r.newest, tuple(sorted((s["from"], s["to"]) for s in r.spans if s["to"] > s["from"]))) for r in out.collect()}
    assert plain(lifetimes(df, hot_rows=20)) == plain(lifetimes(df))


def test_runs(spark):
    rows = spark.createDataFrame([("f", "x", 0, n) for n in (1, 2, 2, 3, 7, 8)], "field string, family string, block long, n long")
    assert {(r.first, r.last) for r in runs(rows).collect()} == {(1, 3), (7, 8)}
