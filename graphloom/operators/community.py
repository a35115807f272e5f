"""Communities, brokers and co-changes of a graph (src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.scratch import materialize, release
from graphloom.operators.setjoin import pairs_within


def communities(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, community) after synchronous rounds of label propagation over undirected links.

    All nodes start with their own name; in each round every node takes the name that most of its neighbours have, of equals the least.
    Links count once, loops and null ends not at all. Names are counted before they are shuffled.
    """
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = materialize(both.where("src <> dst").distinct())
    now = links.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        said = links.join(now.select(F.col("node").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.count("*").alias("n"))
        most = said.groupBy("src").agg(F.max("n").alias("n"))
        new = said.join(most, ["src", "n"]).groupBy(F.col("src").alias("node")).agg(F.min("community").alias("community"))
        last, now = now, materialize(new)
        release(last)
    return now


def co_changes(changes: DataFrame, change: str, item: str, least: int = 2) -> DataFrame:
    """(a, b, n, lift): items a < b that change together `least` times or more, and how much more often than by chance.

    lift = n * all changes / (changes of a * changes of b). Repeated rows count once.
    """
    once = materialize(changes.select(change, item).dropna().distinct())
    total = once.agg(F.count_distinct(change).alias("total"))
    own = once.groupBy(item).agg(F.count("*").alias("own"))
    met = pairs_within(once, change, item, least)
    a = own.select(F.col(item).alias("a"), F.col("own").alias("na"))
    b = own.select(F.col(item).alias("b"), F.col("own").alias("nb"))
    known = met.join(a, "a").join(b, "b").crossJoin(F.broadcast(total))  # one row
    return known.select("a", "b", "n", (F.col("n") * F.col("total") / (F.col("na") * F.col("nb"))).alias("lift"))


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, score): the share of shortest paths from the sources (node) that lead through each node, added up (Brandes, 2001).

    Exact if the sources are all nodes; a sample of them gives an estimate. All sources go outward a level a round, counting
    their shortest paths, and back again; rows are pairs of a source and a node that it reaches.
    """
    e = materialize(edges.select("src", "dst").where("src <> dst").distinct())
    start = sources.select(F.col("node").alias("s"), "node").where("node IS NOT NULL").distinct()
    levels = [materialize(start.withColumn("paths", F.lit(1.0)))]
    seen = levels[0].select("s", "node")
    while True:
        far = levels[-1].join(e.withColumnRenamed("src", "node"), "node").groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        new = materialize(far.join(seen, ["s", "node"], "left_anti"))
        if new.isEmpty():
            break
        levels.append(new)
        seen = reduce(DataFrame.unionAll, [x.select("s", "node") for x in levels])
    rests = []
    below = None
    for level in reversed(levels[1:]):
        if below is None:
            held = level.withColumn("rest", F.lit(0.0))
        else:
            out = below.select("s", F.col("node").alias("dst"), ((1 + F.col("rest")) / F.col("paths")).alias("each")).join(e, "dst")
            sums = out.groupBy("s", F.col("src").alias("node")).agg(F.sum("each").alias("each"))
            held = level.join(sums, ["s", "node"], "left").select("s", "node", "paths", (F.col("paths") * F.coalesce("each", F.lit(0.0))).alias("rest"))
        below = materialize(held)
        rests.append(below.select("node", "rest"))
    none = levels[0].select("node", F.lit(0.0).alias("rest")).limit(0)
    return reduce(DataFrame.unionAll, rests, none).groupBy("node").agg(F.sum("rest").alias("score")).where("score > 0")
