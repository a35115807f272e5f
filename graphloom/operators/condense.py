"""Strongly connected components, build layers and cycles of a directed graph, in rounds of joins.

Components: every node learns the least node that reaches it and the least that it reaches. Both spread along edges, and a node also
takes over what the node that it has learned of knows (a pointer jump), so a round covers a multiple of the
distance of the one before and a phase ends after about the logarithm of the longest distance. Where the two are equal the node is in that
one's component. All others go on with the edges between nodes that have learned the same pair, as nodes of one component
do; after each phase nodes without such an edge in or out are components of their own. The least node of each part is settled in
each phase, so phases end.

Layers: a component is one above the highest that it depends on. Each holds a lower bound and a node of a path that proves it,
with the length of the path that far; bounds rise along edges and along these paths, whose lengths double where
paths are chains. Rounds are thus at most the number of layers, and about its logarithm along chains.

Each round is one job that writes its state to shared storage and counts what changed on the way; no task holds the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.operators.scratch import materialize, release


def _write(df: DataFrame, changed: str) -> tuple[DataFrame, int]:
    """df written, and for how many rows `changed` holds."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count_if(F.expr(changed)).alias("n")))
    return out, seen.get["n"]


def _learn(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, f, b): the least node that reaches each node, and the least that it reaches, itself included."""
    now = nodes.select("node", F.col("node").alias("f"), F.col("node").alias("b"))
    while True:
        from_src = edges.join(now.select(F.col("node").alias("src"), "f"), "src").select(F.col("dst").alias("node"), "f", F.lit(None).alias("b"))
        from_dst = edges.join(now.select(F.col("node").alias("dst"), "b"), "dst").select(F.col("src").alias("node"), F.lit(None).alias("f"), "b")
        got = from_src.unionAll(from_dst).groupBy("node").agg(F.min("f").alias("gf"), F.min("b").alias("gb"))
        near = now.join(got, "node", "left").select("node", F.col("f").alias("of"), F.col("b").alias("ob"), F.least("f", "gf").alias("f"), F.least("b", "gb").alias("b"))
        jump_f = now.select(F.col("node").alias("f"), F.col("f").alias("jf"))
        jump_b = now.select(F.col("node").alias("b"), F.col("b").alias("jb"))
        far = near.join(jump_f, "f").join(jump_b, "b").select("node", "of", "ob", F.least("f", "jf").alias("f"), F.least("b", "jb").alias("b"))
        new, changed = _write(far, "f < of OR b < ob")
        release(now)
        now = new.select("node", "f", "b")
        now.scratch_path = new.scratch_path  # for release
        if not changed:
            return now


def least_above(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(node, value): the least value (node, value) of each node and of all that reach it.

    The node that a value comes from goes along, so what is known there is taken over in one step.
    """
    now = values.select("node", F.struct("value", "node").alias("f"))
    while True:
        got = edges.join(now.select(F.col("node").alias("src"), "f"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("f").alias("g"))
        near = now.join(got, "node", "left").select("node", F.col("f").alias("old"), F.least("f", "g").alias("f"))
        far = near.join(now.select(F.col("node").alias("from"), F.col("f").alias("jump")), near["f"]["node"] == F.col("from"))
        new, changed = _write(far.select("node", "old", F.least("f", "jump").alias("f")), "f < old")
        release(now)
        now = new.select("node", "f")
        now.scratch_path = new.scratch_path
        if not changed:
            return now.select("node", F.col("f.value").alias("value"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its least node."""
    now = materialize(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    left = now.select(F.col("src").alias("node")).unionAll(now.select(F.col("dst").alias("node"))).distinct()
    kept, out = [now], []
    while True:
        inner = now.where("src <> dst")
        inside = inner.select(F.col("src").alias("node")).intersect(inner.select(F.col("dst").alias("node")))
        active = materialize(left.join(inside, "node", "left_semi"))
        out.append(left.join(active, "node", "left_anti").select("node", F.col("node").alias("component")))
        ends = [active.select(F.col("node").alias(c)) for c in ("src", "dst")]
        here, n = _write(inner.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi"), "true")
        kept += [active, here]
        if not n:  # what is left has no edge of its own
            out.append(active.select("node", F.col("node").alias("component")))
            break
        known = _learn(here, active)
        out.append(known.where("f = b").select("node", F.col("f").alias("component")))
        rest = known.where("f <> b")
        s = rest.select(F.col("node").alias("src"), F.col("f").alias("sf"), F.col("b").alias("sb"))
        d = rest.select(F.col("node").alias("dst"), F.col("f").alias("df"), F.col("b").alias("db"))
        now, n = _write(here.join(s, "src").join(d, "dst").where("sf = df AND sb = db").select("src", "dst"), "true")
        left = rest.select("node")
        kept += [known, now]
        if not n:
            out.append(left.select("node", F.col("node").alias("component")))
            break
    found = materialize(reduce(DataFrame.unionAll, out))
    for x in kept:
        release(x)
    return found


def layers(needs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, layer) of an acyclic graph (src, dst), where src depends on dst: 0 without dependencies, else one above the highest."""
    now = nodes.select("node", F.lit(0).cast("bigint").alias("layer"), F.lit(None).cast(dict(nodes.dtypes)["node"]).alias("far"), F.lit(0).cast("bigint").alias("away"))
    while True:
        state = now.select(F.col("node").alias("dst"), "layer")
        best = needs.join(state, "dst").groupBy(F.col("src").alias("node")).agg(F.max(F.struct(F.col("layer") + 1, "dst")).alias("best"))
        # the path that is known goes on where the one of its end goes
        end = now.select(F.col("node").alias("far"), F.col("layer").alias("end_layer"), F.col("far").alias("next"), F.col("away").alias("more"))
        seen = now.join(best, "node", "left").join(end, "far", "left")
        along = F.col("away") + F.col("end_layer")
        jumped = F.greatest("layer", along)
        step = F.col("best.col1")
        up = step > F.coalesce(jumped, "layer")
        new = seen.select(
            "node",
            F.col("layer").alias("old"),
            F.greatest("layer", along, step).alias("layer"),
            F.when(up, F.col("best.dst")).otherwise(F.coalesce("next", "far")).alias("far"),
            F.when(up, 1).otherwise(F.col("away") + F.when(F.col("next").isNotNull(), F.col("more")).otherwise(0)).alias("away"),
        )
        written, changed = _write(new, "layer > old")
        release(now)
        now = written.drop("old")
        now.scratch_path = written.scratch_path
        if not changed:
            return now.select("node", "layer")


def dependencies(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges between different components (src, dst), each once."""
    s = found.select(F.col("node").alias("src"), F.col("component").alias("a"))
    d = found.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    return edges.join(s, "src").join(d, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def scc_layers(edges: DataFrame) -> DataFrame:
    """(node, component, size, layer) of every node with an edge: its strongly connected component, named by the
    least node, its size, and its build layer: components without dependencies are 0, others one above the highest
    that they depend on."""
    found = components(edges)
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    named = materialize(sizes.select(F.col("component").alias("node")))
    at = layers(materialize(dependencies(edges, found)), named).withColumnRenamed("node", "component")
    return found.join(sizes, "component").join(at, "component").select("node", "component", "size", "layer")


def cycles(edges: DataFrame) -> DataFrame:
    """(component, size) of components of more than one node, and of nodes that point at themselves."""
    parts = components(edges).groupBy("component").agg(F.count("*").alias("size"))
    own = edges.where("src = dst").select(F.col("src").alias("component")).distinct()
    return parts.join(own.withColumn("own", F.lit(True)), "component", "left").where("size > 1 OR own").select("component", "size")
