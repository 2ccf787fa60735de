"""Sources and sinks on small cases."""

from lexloom.sources.files import text_parts
from lexloom.sources.listing_source import ListingSource


def test_unreadable_lines_and_filters(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"source": "x", "title": "t"}\n{"source": "y"}\nbroken{\n[1]\n')
    (tmp_path / "_SUCCESS").write_text("")
    spark.dataSource.register(ListingSource)
    rows = spark.read.format("landed_listings").option("path", str(tmp_path)).load().collect()
    assert sorted((r.source or "", r.unread or "") for r in rows) == [("", "[1]"), ("", "broken{"), ("x", ""), ("y", "")]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kept = spark.read.format("landed_listings").option("path", str(tmp_path)).option("pushdown", "true").load().where("source = 'x' and title is not null")
    assert [r.source for r in kept.collect()] == ["x"]
    assert spark.read.format("landed_listings").option("path", str(tmp_path)).load().where("source = 'y'").count() == 1


def test_parts(spark):
    rows = [("a", i, f"c{i}", "x" * n) for i, n in enumerate([4, 4, 4, 30, 1, 9, 1])] + [("b", 0, "d", None), (None, 0, "e", "x"), ("c", 0, "f", "é")]
    out = {(r.doc_key, r.part): (r.chunks, r.bytes) for r in text_parts(spark.createDataFrame(rows, "doc_key string, seq int, id string, text string"), 10).collect()}
    assert out == {("a", 0): (2, 8), ("a", 1): (1, 4), ("a", 2): (1, 30), ("a", 3): (2, 10), ("a", 4): (1, 1), ("c", 0): (1, 2)}
