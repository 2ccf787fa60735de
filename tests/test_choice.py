"""Choice of files and filters on small cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lexloom.operators import cdc, choice
from lexloom.operators.filters import LawFilter, has_all_words, in_scopes


def test_filters(spark):
    df = spark.createDataFrame([("act:1/2000", "act", 2000, "A 100% Act"), ("sc:x", "judgment", None, "a_b"), (None, None, 1990, None)], "k string, kind string, y int, t string")
    keys = lambda f: [r.k for r in df.where(f.column(F.col("k"), F.col("kind"), F.col("y"))).collect()]
    assert keys(LawFilter()) == ["act:1/2000", "sc:x", None] and keys(LawFilter(only="judgments")) == ["sc:x"] and keys(LawFilter(year_from=1999.9)) == ["act:1/2000"]
    assert keys(LawFilter(doc_keys=("' OR 1=1 --",))) == []
    for wrong in ({"only": "everything"}, {"year_from": float("nan")}):
        with pytest.raises(ValueError):
            LawFilter(**wrong)
    assert [r.k for r in df.where(has_all_words(F.col("t"), "100% act")).collect()] == ["act:1/2000"] and df.where(has_all_words(F.col("t"), "a_c")).count() == 0
    scopes = F.array(F.col("k"), F.col("kind"))
    assert df.where(in_scopes(scopes, ["act"])).count() == 1 and df.where(in_scopes(scopes, [])).count() == 0


def test_choice(spark):
    rows = [(1, "a", "act:1/2000", "ENGLISH", "pdf"), (2, "b", "act:1/2000", "SINHALA", "pdf"), (3, "b", "ACT:01/2000", "TAMIL", None), (4, "b", None, "ENGLISH", "pdf"), (5, "z", "cap:1", None, None), (6, "a", "cap:2", "ENGLISH", "pdf")]
    listings = spark.createDataFrame(rows, "id long, source string, listed_key string, label string, file_format string")
    trust = spark.createDataFrame([("a", 1), ("b", 2)], "source string, trust int")
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    held, pins = table([(2,), (3,)], "listing long"), table([("act:1/2000", 3)], "doc_key string, listing long")
    none = table([], "listing long")
    rekeys = table([(4, "cap:1")], "listing long, key string")
    choose = lambda *a: {r.doc_key: (r.chosen, r.fetch) for r in choice.choose(choice.candidates(listings, trust, held, *a)).collect()}
    assert choose(pins, none, rekeys) == {"act:1/2000": (3, 1), "cap:1": (None, 4), "cap:2": (None, 6)}
    assert choose(pins.limit(0), table([(1,)], "listing long"), rekeys.limit(0)) == {"act:1/2000": (2, None), "cap:1": (None, 5), "cap:2": (None, 6)}
    assert choice.choose(choice.candidates(listings.limit(0), trust, held, pins, none, rekeys)).count() == 0


def test_years(spark):
    held = spark.createDataFrame([(2023,), (2025,), (2026,), (None,)], "year int")
    years = lambda today: sorted(r.year for r in choice.years_due(held, 2022, today).collect())
    assert years(date(2026, 1, 9)) == [2022, 2024, 2025, 2026] and years(date(2026, 2, 9)) == [2022, 2024, 2026]


def test_merge_upsert(spark):
    schema = "k string, n long, t string, j string, change string"
    old = spark.createDataFrame([("a", 1, "x", '{"p": "1", "q": "2"}', None), ("b", 1, "x", None, None), ("d", 1, "x", '{"p":"1"}', None)], schema).drop("change")
    new = spark.createDataFrame([("a", 1, "y", "{}", None), ("a", 2, "x", '{"p": "9"}', None), ("c", 1, "x", "{}", None), ("d", 1, "x", '{"p": "1"}', None)], schema).drop("change")
    out = {r.k: (r.n, r.j, r.change) for r in cdc.merge_upsert(old, new, ["k"], "n", "j").collect()}
    assert out == {"a": (2, '{"p":"9","q":"2"}', "changed"), "b": (1, None, "kept"), "c": (1, "{}", "inserted"), "d": (1, '{"p":"1"}', "same")}
    assert sorted((r.k, r.n) for r in cdc.upsert(old, new, ["k"]).collect()) == [("a", 2), ("b", 1), ("c", 1), ("d", 1)]
