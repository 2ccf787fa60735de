"""Usage reports on small ledgers."""

from datetime import date, datetime

from lexloom.operators import links, usage
from lexloom.operators.search import best_of_groups
from lexloom.plans.usage import members


def test_days_without_events_are_zeros(spark):
    rows = [(datetime(2024, 1, 1, 3), 1.0), (datetime(2024, 1, 1, 20), 2.0), (datetime(2024, 1, 4, 1), None), (None, 9.0)]
    out = {r.day: (r.events, r.cost) for r in usage.daily(spark.createDataFrame(rows, "at timestamp, cost double"), "at", "cost").collect()}
    # 20:00 UTC is the next home day.
    assert out == {date(2024, 1, 1): (1, 1.0), date(2024, 1, 2): (1, 2.0), date(2024, 1, 3): (0, 0.0), date(2024, 1, 4): (1, 0.0)}


def test_parts_are_those_named(spark):
    mentions = spark.createDataFrame([(1, "repeals", "a", ["Part III"]), (2, "repeals", "a", ["Part IX"]), (3, "cites", "a", ["Part III"])], "id long, kind string, dst_doc string, labels array<string>")
    units = spark.createDataFrame([("a", "Part III", "4", 4, "c4"), ("a", "Part III", "5", 5, "c5"), ("a", "Part I", "1", 1, "c1")], "doc_key string, scope string, label string, seq int, id string")
    pairs = spark.createDataFrame([], "doc string, twin string")
    assert {(r.id, r.part, r.dst_chunk) for r in links.part_links(mentions, pairs, units).collect()} == {(1, "Part III", "c4"), (1, "Part III", "c5")}


def test_best_of_groups_has_every_group(spark):
    rows = [(i, [1.0, i / 100.0], "near" if i < 60 else "far" if i < 99 else None) for i in range(100)] + [(200, [0.0, 0.0], "zero"), (201, None, "none")]
    v = spark.createDataFrame(rows, "id long, v array<double>, g string")
    out = {(r.query, r.group): (r.hit, r.rank) for r in best_of_groups(v, v.where("id = 0"), "id", "v", "g", per_pass=1).collect()}
    assert out == {(0, "near"): (1, 1), (0, "far"): (60, 2), (0, None): (99, 3)}
    assert best_of_groups(v, v.limit(0), "id", "v", "g").count() == 0


def joined_rows(plan):
    """Rows out of the joins of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return joined_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return joined_rows(plan.plan())
    below = [n for i in range(plan.children().size()) for n in joined_rows(plan.children().apply(i))]
    return below + ([plan.metrics().apply("numOutputRows").value()] if kind.endswith("JoinExec") else [])


def test_members_are_counted_without_pairs(spark, tmp_path):
    nations = [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (4, "d"), (None, "e")]
    customers = [(i, 1, float(i), "x" if i % 2 else "y") for i in range(300)] + [(0, 1, 0.0, "y"), (300, 2, -1.236, "x"), (301, None, 5.0, "z"), (302, 9, 5.0, "z"), (None, 4, None, None)]
    suppliers = [(i, 1) for i in range(200)] + [(0, 1), (200, 3), (201, None), (None, 4)]
    for name, rows, schema in (("nation", nations, "n_nationkey int, n_name string"), ("customer", customers, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string"), ("supplier", suppliers, "s_suppkey long, s_nationkey int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    df = members(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("a", 1, 300, 200, 299.0, "y"), ("b", 2, 1, 0, -1.24, "one"), ("c", 3, 0, 1, None, "one"), ("d", 4, 0, 0, None, "one"), ("e", None, 0, 0, None, "one")]
    joins = joined_rows(df._jdf.queryExecution().executedPlan())
    assert joins and max(joins) <= len(nations)
