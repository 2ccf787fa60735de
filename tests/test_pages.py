"""Pages, labels and reads on small cases."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import labels as lb
from lexloom.functions import periods
from lexloom.operators import cases, pages, quality
from lexloom.operators import graph as g


def test_running_titles_and_words(spark):
    rows = [("d", f"p{i}", f"MILLS ACT  {i}\nSome text of page number {'x' * i}") for i in range(6)] + [("d", "p9", None), ("e", "q", "")]
    blocks = pages.blocks_of(spark.createDataFrame(rows, "d string, p string, text string"), "d", "p", "text")
    assert [(r.d, r.title, r.pages) for r in pages.running_titles(blocks, "d", "p").collect()] == [("d", "millsact", 6)]
    words = pages.words_of(blocks.where("n = 0 and p = 'p1'"), ["p"]).collect()
    assert [(w.word, w.left, w.right) for w in words] == [("MILLS", 0, 5), ("ACT", 6, 9), ("1", 11, 12)]


def test_gutter_lies_between_columns(spark):
    lines = "\n".join("one two  three    four five six" for _ in range(5))
    blocks = pages.blocks_of(spark.createDataFrame([("d", "p", lines)], "d string, p string, text string"), "d", "p", "text")
    got = pages.gutters(pages.words_of(blocks, ["p"]), ["p"], 1).first()
    assert 14 <= got.gutter <= 18 and got.crossed == 0


def test_rows_of_html(spark):
    html = '<table><tr><td width="90">Short title</td><td><b>1.</b> This &amp; that</td></tr><tr><td width="400">No note</td></tr></table>'
    row = spark.createDataFrame([(html,), (None,)], "h string").select(pages.html_rows(F.col("h")).alias("r"))
    assert sorted((x.note or "", x.text) for r in row.where("r is not null").collect() for x in r.r) == [("", "No note"), ("Short title", "1. This & that")]


def test_labels(spark):
    df = spark.createDataFrame([("First", "3-6", "FIRST  schedule"), ("22nd", "9", "12A"), ("x", "6-3", " "), (None, None, None)], "o string, p string, l string")
    got = df.select(lb.ordinal(F.col("o")), lb.page_range(F.col("p"), 5), lb.schedule_name(F.col("l")), lb.provision_kind(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [(1, (3, 5), "First Schedule", "schedule"), (22, None, None, "section"), (None, None, None, "whole"), (None, None, None, "whole")]
    keys = spark.createDataFrame([("act:9/2023",), ("gazette:1234/05",), ("cap:12",), ("sc:sc-1",), ("constitution",)], "k string").select(lb.shown_key(F.col("k"))).collect()
    assert [r[0] for r in keys] == ["Act, No. 9 of 2023", "Gazette No. 1234/05", "Chapter 12", "Supreme Court, SC-1", "Constitution"]


def test_periods(spark):
    now = F.lit("2024-03-31 20:00:00").cast("timestamp")
    row = lambda name: tuple(str(x) for x in spark.range(1).select(*periods.period(name, now)).first())
    # 20:00 UTC is 01:30 of the next home day.
    assert row("today") == ("2024-03-31 18:30:00", "2024-04-01 18:30:00") and row("last_month") == ("2024-02-29 18:30:00", "2024-03-31 18:30:00")
    with pytest.raises(ValueError):
        periods.period("someday", now)


def test_replayed_log(spark):
    log = [("c", 1, "make", None, None, 1), ("c", 1, "set", "a", "x", 2), ("c", 1, "set", "a", "y", 3), ("c", 1, "clear", "b", None, 4), ("c", 2, "set", "a", "z", 1), ("c", 2, "remove", None, None, 2), ("c", 3, "remove", None, None, 1), ("c", 3, "make", None, None, 2)]
    df = spark.createDataFrame(log, "c string, i int, does string, name string, value string, at int")
    assert {r.i: r.fields for r in cases.replayed(df, "c", "i", "does", "name", "value", ["at"]).collect()} == {1: {"a": "y"}, 3: {}}


def test_gate_and_release(spark):
    lost = spark.createDataFrame([("a", "1", 1, 0), ("a", "2", 1, 0), ("b", "1", 0, 1), ("c", "9", 2, 0)], "doc_key string, label string, lost int, gained int")
    accepted = spark.createDataFrame([("a", "1", "moved"), ("c", None, "gone")], "doc_key string, label string, reason string")
    assert {(r.doc_key, r.label): (r.reason, r.fails) for r in quality.gate(lost, accepted).collect()} == {("a", "1"): ("moved", False), ("a", "2"): (None, True), ("c", "9"): ("gone", False)}
    old, new = (spark.createDataFrame([(k, v) for k in "abc"], "doc_key string, v int") for v in (1, 2))
    actions = spark.createDataFrame([("a", "replace"), ("b", "keep"), ("c", "remove")], "doc_key string, action string")
    assert sorted((r.doc_key, r.v) for r in quality.published(old, new, actions).collect()) == [("a", 2), ("b", 1)]


def test_status_in_words(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, CAST(null AS timestamp), CAST(null AS timestamp)), (2, timestamp'2024-01-02', timestamp'2024-01-01') AS t(sections, last_change, last_repeal)")
    assert [r.status for r in g.status_sentence(rows).collect()] == ["Changed by 1 section.", "Changed by 2 sections, last on 2024-01-02; repealed on 2024-01-01."]
