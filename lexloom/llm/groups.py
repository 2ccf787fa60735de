"""One identifier for all records that hang together, by low-diameter decomposition of the graph of their pairs.

Each round draws an exponential shift for every vertex; clusters grow from the vertices in the order of their shifted start
times, one edge a step; each cluster becomes one vertex of the next round's graph, whose edges are those between clusters.
A step is one join and one aggregate, and a round leaves a constant part of the edges, so the number of rounds is logarithmic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.skew import HOT_ROWS, spread_join
from lexloom.tables import cut, drop

#: Rate of the exponential shifts: the smaller, the larger the clusters and the more steps they take to grow.
RATE = 0.1
#: Steps of growth a round. A cluster that would still grow is only smaller: every round is right whatever the steps.
STEPS = 5
#: Copies of the label of a hot vertex, over which its edges are spread.
SALTS = 64


def _salted(edges: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both directions of each edge and a step of length 0 from each vertex to itself, those of hot vertices spread over salts; the hot vertices.

    There are at most edges * 2 / hot_rows hot vertices, so the broadcast is bounded by their definition.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("length")).union(edges.select(F.col("b"), F.col("a"), F.lit(1)))
    hot = both.groupBy("src").count().where(F.col("count") >= hot_rows).select("src", F.lit(SALTS).alias("salts"))
    every = both.union(both.select("src", F.col("src"), F.lit(0)).distinct())
    marked = every.join(F.broadcast(hot), "src", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.lit(SALTS))).cast("int"))
    return marked.select("src", "dst", "length", "salt"), hot


def grow(edges: DataFrame, level: int, rate: float = RATE, steps: int = STEPS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(v, center) for every vertex of edges (a, b): the cluster whose shifted front reaches v first within the steps."""
    both, hot = _salted(edges, hot_rows)
    both, hot = cut(both), cut(hot)
    chance = (F.pmod(F.xxhash64("v", F.lit(level)), F.lit(1 << 52)) + 1) / float(1 << 52)
    labels = both.where("length = 0").select(F.col("src").alias("v")).withColumn("at", F.log(chance) / rate).withColumn("center", F.col("v"))
    for _ in range(steps):
        sent = labels.join(F.broadcast(hot.withColumnRenamed("src", "v")), "v", "left")
        sent = sent.withColumn("salt", F.explode(F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        reached = both.join(sent.select(F.col("v").alias("src"), "salt", "at", "center"), ["src", "salt"]).select(F.col("dst").alias("v"), (F.col("at") + F.col("length")).alias("at"), "center")
        labels = reached.groupBy("v").agg(F.min(F.struct("at", "center")).alias("first")).select("v", "first.at", "first.center")
    return labels.select("v", "center")


def components(pairs: DataFrame, a: str, b: str, hot_rows: int = HOT_ROWS, rate: float = RATE, steps: int = STEPS) -> DataFrame:
    """(member, group) of every record in pairs: group is the smallest member, by bytes, of all linked directly or indirectly.

    A pair with itself makes a group of one; a null on one side leaves the other side's record in the result without linking
    it; repeated and turned pairs are of no effect; no pairs give no rows. Other columns are not read.
    """
    ends = cut(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    members = ends.select(F.col("a").alias("member")).union(ends.select("b")).where("member is not null").distinct()
    edges = cut(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        labels = cut(grow(edges, len(levels), rate, steps, hot_rows))
        levels.append(labels)
        last, edges = edges, cut(_contract(edges, labels, hot_rows))
        drop(edges.sparkSession, last)
    group = None
    for labels in reversed(levels):
        group = labels.withColumnRenamed("center", "root") if group is None else cut(_up(labels, group, hot_rows))
    if group is None:
        return members.withColumn("group", F.col("member"))
    smallest = group.groupBy("root").agg(F.min(F.least("v", "root")).alias("group"), F.count("*").alias("rows"))
    named = spread_join(group, smallest, "root", "rows", ["group"], hot_rows).select(F.col("v").alias("member"), "group")
    return members.join(named, "member", "left").select("member", F.coalesce("group", "member").alias("group"))


def _contract(edges: DataFrame, labels: DataFrame, hot_rows: int) -> DataFrame:
    """Edges between clusters, each once."""
    degrees = edges.select(F.col("a").alias("v")).union(edges.select("b")).groupBy("v").agg(F.count("*").alias("rows"))
    known = labels.join(degrees, "v").select("v", "rows", F.col("center").alias("to"))
    one = spread_join(edges, known, "a", "rows", ["to"], hot_rows).select(F.col("to").alias("a"), "b")
    two = spread_join(one, known, "b", "rows", ["to"], hot_rows).select("a", F.col("to").alias("b"))
    return two.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _up(labels: DataFrame, roots: DataFrame, hot_rows: int) -> DataFrame:
    """Compose a round's assignment with that of the rounds after it; a cluster without edges left is its own root."""
    sizes = labels.groupBy("center").agg(F.count("*").alias("rows"))
    known = sizes.join(roots, F.col("center") == F.col("v"), "left").select("center", "rows", F.coalesce("root", "center").alias("root"))
    return spread_join(labels, known, "center", "rows", ["root"], hot_rows).select("v", "root")
