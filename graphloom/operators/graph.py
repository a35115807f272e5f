"""Graph operators on an edge DataFrame (src, dst).

Bounded walks are a fixed number of joins in one plan. Fix-points run in rounds, each written to shared storage.
Components, layers, cycles and reachable sets are in `pieces` (large pieces in `condense` and `closure`), forests in `forest`, weighted paths in `paths`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.pieces import closure_counts, cycles, scc_layers
from graphloom.operators.scratch import materialize

__all__ = [
    "chain_order", "closure_counts", "cycles", "edges_between", "pagerank", "primary_parents", "scc_layers", "walk",
    "walk_limited", "weighted_neighborhood",
]

def walk(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of the nodes reached from `starts` (node) in up to `depth` steps, without the starts."""
    step = edges.select(F.col("src").alias("node"), "dst")
    seen = starts.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        reached = front.join(step, "node").select(F.col("dst").alias("node")).distinct()
        front = reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionAll(front)
    return seen.where("depth > 0")


def walk_limited(edges: DataFrame, start: int, depth: int, limit: int) -> DataFrame:
    """(node, depth, ord, truncated): the walk's nodes by level, then their parent's place, then key; `limit` at most.

    `truncated` is set as soon as the limit is reached, also when nothing was left out.
    """
    step = edges.select(F.col("src").alias("parent"), "dst")
    spark = edges.sparkSession
    seen = spark.range(1).select(F.lit(start).cast("bigint").alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("ord"))
    front = seen
    for d in range(1, depth + 1):
        met = front.select(F.col("node").alias("parent"), F.col("ord").alias("_p")).join(step, "parent")
        new = met.groupBy(F.col("dst").alias("node")).agg(F.min("_p").alias("_p"))
        new = new.join(seen.select("node"), "node", "left_anti").orderBy("_p", "node").limit(limit)
        w = Window.orderBy("_p", "node")  # at most `limit` rows
        front = new.select("node", F.lit(d).alias("depth"), F.row_number().over(w).cast("bigint").alias("ord"))
        seen = seen.unionAll(front)
    w = Window.orderBy("depth", "ord")
    out = seen.where("depth > 0").select("node", "depth", F.row_number().over(w).cast("bigint").alias("ord"))
    out = out.where(F.col("ord") <= limit)
    return out.withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(1))) >= limit)


def weighted_neighborhood(edges: DataFrame, start: str | int, depth: int, least: float) -> DataFrame:
    """(node, depth, via array) over edges of weight `least` or more; via is the least path among the shortest."""
    step = edges.where(F.col("w") >= least).select(F.col("src").alias("node"), "dst")
    first = step.limit(0).select("node").unionAll(edges.sparkSession.range(1).select(F.lit(start).alias("node")))
    seen = first.select("node", F.lit(0).alias("depth"), F.array("node").alias("via"))
    front = seen
    for d in range(1, depth + 1):
        reached = front.join(step, "node").groupBy("dst").agg(F.min("via").alias("via"))
        new = reached.select(F.col("dst").alias("node"), F.lit(d).alias("depth"), F.concat("via", F.array("dst")).alias("via"))
        front = new.join(seen.select("node"), "node", "left_anti")
        seen = seen.unionAll(front)
    return seen.where("depth > 0")


def chain_order(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, position) of revisions (id, parent) that form one chain, by pointer doubling.

    No rows unless there is exactly one root, no parent has two children, none is missing and no id repeats.
    """
    n = links.agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("ids"),
        F.count_distinct("parent").alias("parents"),
        F.count("parent").alias("with_parent"),
    ).first()
    dangling = links.where("parent IS NOT NULL").join(links.select(F.col("id").alias("parent")), "parent", "left_anti")
    valid = n["n"] == n["ids"] and n["parents"] == n["with_parent"] == n["n"] - 1 and dangling.isEmpty()
    kind = dict(links.dtypes)["id"]
    if not valid:
        return links.sparkSession.createDataFrame([], f"id {kind}, position bigint")
    now = materialize(links.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("position")))
    for _ in range(rounds):
        if now.where("up IS NOT NULL").isEmpty():
            break
        above = now.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("position").alias("more"))
        now = materialize(now.join(above, "up", "left").select("id", F.col("up2").alias("up"), (F.col("position") + F.coalesce("more", F.lit(0))).alias("position")))
    done = now.where("up IS NULL").select("id", "position")
    return done if done.count() == n["n"] else done.limit(0)


def primary_parents(edges: DataFrame) -> DataFrame:
    """(node, parent): of the nodes that import a node, the one most imported itself, the least key of equals."""
    into = edges.groupBy("dst").agg(F.count("*").alias("fan_in"))
    rated = edges.join(into.withColumnRenamed("dst", "src"), "src", "left")
    rank = F.struct(F.coalesce("fan_in", F.lit(0)), -F.col("src"))
    return rated.groupBy(F.col("dst").alias("node")).agg(F.max_by("src", rank).alias("parent"))


def edges_between(edges: DataFrame, modules: DataFrame, limit: int) -> DataFrame:
    """(sm, dm, src, dst, rank): the first `limit` file edges that make each module edge."""
    s = modules.select(F.col("node").alias("src"), F.col("module").alias("sm"))
    d = modules.select(F.col("node").alias("dst"), F.col("module").alias("dm"))
    met = edges.join(s, "src").join(d, "dst").where("sm <> dm")
    w = Window.partitionBy("sm", "dm").orderBy("src", "dst")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds; the mass of nodes without edges out is dealt to all."""
    e = edges.select("src", "dst").distinct()
    links = materialize(e.join(e.groupBy("src").agg(F.count("*").alias("n")), "src"))
    ends = links.select(F.col("src").alias("node")).unionAll(links.select(F.col("dst").alias("node"))).distinct()
    total = max(1, ends.count())
    nodes = ranks = materialize(ends.withColumn("rank", F.lit(1.0 / total)))
    for i in range(rounds):
        sent = links.join(ranks.withColumnRenamed("node", "src"), "src")
        got = sent.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        kept = got.agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("kept"))  # one row
        met = nodes.select("node").join(got, "node", "left").crossJoin(F.broadcast(kept))
        share = F.coalesce("got", F.lit(0.0)) + (1 - F.col("kept")) / total
        ranks = met.select("node", ((1 - damping) / total + damping * share).alias("rank"))
        if i % 2:  # keeps the plan of a round from growing
            ranks = materialize(ranks)
    return ranks
