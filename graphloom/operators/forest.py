"""Forests out of a graph: each node's primary parent, cycles of parents cut, and sums over subtrees, in a logarithm of rounds.

Pointers are doubled: after k rounds a node knows its ancestor 2^k steps up, and what lies on the way. Where every node has
one parent at most, a node that still has an ancestor after as many steps as there are nodes leads into a ring, and the ancestors
found then are the rings' nodes.

Every round joins each node to its pointer's row and writes the state to shared storage. A parent that a large share of the nodes
have is one row on the small side of that join, which adaptive execution splits; sums over children are added up before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.operators.scratch import materialize, release


def support_scores(edges: DataFrame, reached: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """(node, support, n_in, n_out) of every node with an edge; an edge (src, dst) says that src uses dst.

    `reached` (node, n) counts the nodes that depend on each one, directly or not. Nodes of `tests` (node) carry less.
    """
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(
        edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    degree = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    met = degree.join(reached.select("node", "n"), "node", "left")
    less = F.lit(0.0)
    if tests is not None:
        met = met.join(tests.select("node").distinct().withColumn("_test", F.lit(True)), "node", "left")
        less = F.when(F.col("_test"), 0.35).otherwise(0.0)
    # fixed values: the weights of what depends on a file, of its users and of what it uses
    score = 1 + 2 * F.log1p(F.coalesce("n", F.lit(0))) + F.log1p("n_in") + 0.25 * F.log1p("n_out") - less
    return met.select("node", F.round(score, 9).alias("support"), "n_in", "n_out")


def best_parents(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(node, parent): of what a node uses, the one with the greatest support, then most users, then fewest uses, then greatest name."""
    rank = F.struct("support", "n_in", (-F.col("n_out")).alias("few"), "dst")
    rated = edges.where("src <> dst").join(scores.select(F.col("node").alias("dst"), "support", "n_in", "n_out"), "dst")
    return rated.groupBy(F.col("src").alias("node")).agg(F.max(rank)["dst"].alias("parent"))


def _doubled(now: DataFrame, more: list[Column], names: list[str]) -> DataFrame:
    """Each row with its pointer's pointer; `more` from the columns of both, those of the pointer's row with a leading u_."""
    up = now.select(F.col("node").alias("up"), F.col("up").alias("u_up"), *[F.col(c).alias(f"u_{c}") for c in names])
    return now.join(up, "up", "left").select("node", F.col("u_up").alias("up"), *more)


def cycle_cuts(parents: DataFrame, scores: DataFrame) -> DataFrame:
    """(node, parent): one link of each ring of parents, that of its node with the greatest support, then users, then name."""
    kept = parents.where("parent IS NOT NULL")
    roots = kept.select(F.col("parent").alias("node")).join(kept.select("node"), "node", "left_anti").distinct()
    links = kept.select("node", F.col("parent").alias("up")).unionAll(roots.select("node", F.lit(None).alias("up")))
    rank = F.struct("support", "n_in", "node")
    now = materialize(links.join(scores.select("node", "support", "n_in"), "node", "left").select("node", "up", rank.alias("best")))
    n, steps = now.count(), 1
    while steps < n:  # `best` is over the steps that `up` skips
        seen = Observation()
        new = _doubled(now, [F.greatest("best", "u_best").alias("best")], ["best"])
        last, now = now, materialize(new.observe(seen, F.count("up").alias("n")))
        release(last)
        steps *= 2
        if not seen.get["n"]:
            return parents.limit(0).select("node", "parent")
    ring = now.where("up IS NOT NULL").select(F.col("up").alias("node")).distinct()
    cut = now.join(ring, "node", "left_semi").select(F.col("best.node").alias("node")).distinct()
    return kept.join(cut, "node", "left_semi").select("node", "parent")


def subtree_sums(parents: DataFrame, values: DataFrame) -> DataFrame:
    """(node, total): the values (node, value) of each node and of all below it in a forest (node, parent), null for a root.

    After k rounds a node has the sum of what is fewer than 2^k steps below; those exactly so far below bring the rest.
    """
    links = parents.where("parent IS NOT NULL").select("node", F.col("parent").alias("up"))
    every = values.select("node").unionAll(links.select("node")).unionAll(links.select(F.col("up").alias("node"))).distinct()
    start = every.join(links, "node", "left").join(values, "node", "left")
    now = materialize(start.select("node", "up", F.coalesce("value", F.lit(0)).alias("total")))
    while True:
        seen = Observation()
        below = now.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("total").alias("more"))
        up = now.select(F.col("node").alias("up"), F.col("up").alias("next"))
        new = now.join(below, "node", "left").join(up, "up", "left")
        new = new.select("node", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"))
        last, now = now, materialize(new.observe(seen, F.count("up").alias("n")))
        release(last)
        if not seen.get["n"]:
            return now.select("node", "total")


def forest(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(node, parent, cut, demand) of every node with an edge.

    parent is null for roots and where a ring was cut, cut is the parent that was taken away there. The demand of a node is that of its
    children, or 1 without any: how many leaves it carries.
    """
    parents = materialize(best_parents(edges, scores))
    cuts = materialize(cycle_cuts(parents, scores))
    kept = parents.join(cuts.select("node"), "node", "left_anti")
    inner = kept.select(F.col("parent").alias("node")).distinct().withColumn("_inner", F.lit(1))
    leaf = scores.select("node").join(inner, "node", "left").select("node", F.when(F.col("_inner").isNull(), 1).otherwise(0).cast("bigint").alias("value"))
    demand = subtree_sums(kept, leaf)
    cut = cuts.select("node", F.col("parent").alias("cut"))
    return demand.join(kept, "node", "left").join(cut, "node", "left").select("node", "parent", "cut", F.col("total").alias("demand"))
