"""Connected components of an undirected graph, in rounds of joins.

Stars are contracted in turn (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): a round first
links each node's larger neighbours to its least one, then its smaller ones. The edges never become more, and the
rounds grow with the logarithm of a component's diameter. Each round is written to shared storage, so lineage stays
short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.relational import shuffled
from graphloom.operators.scratch import materialize, release


def _least(edges: DataFrame) -> DataFrame:
    """Each node of u with the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(shuffled(_least(both)), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    others = down.join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(id, component) of every node with an edge; a component is named by its least node.

    Null ends and loops are left out, repeated edges count once. More than `rounds` rounds are an error.
    """
    now = materialize(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    )
    seen = None
    for _ in range(rounds):
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not found["n"] or seen == (found["n"], found["h"]):
            break
        seen = (found["n"], found["h"])
        last, now = now, materialize(_small_star(_large_star(now)))
        release(last)
    else:
        raise RuntimeError(f"components are not final after {rounds} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
