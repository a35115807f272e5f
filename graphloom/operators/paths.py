"""Shortest paths over weighted edges (src, dst, w) from several sources, with the way back: what a change floods, and how.

Distances are settled bucket by bucket (delta-stepping, Meyer and Sanders, 2003): the nodes of the nearest bucket of width
`delta` send along their edges until nothing in it gets nearer, then the next non-empty one follows. A round is a join of the nodes that got
nearer, not of all, and is written to shared storage. Weights must be above 0: others are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.operators.scratch import materialize, release


def shortest_paths(edges: DataFrame, sources: DataFrame, delta: float | None = None, limit: float | None = None) -> DataFrame:
    """(node, distance, source, parent) of the nodes that a source (node) reaches, within `limit` where it is given.

    Of equally near sources the least is taken, then the least parent; a source has distance 0 and no parent. `delta` is the
    mean weight by default.
    """
    kinds = dict(edges.dtypes)
    e = materialize(edges.where("src IS NOT NULL AND dst IS NOT NULL AND w IS NOT NULL").groupBy("src", "dst").agg(F.min("w").alias("w")))
    stats = e.agg(F.min("w").alias("least"), F.avg("w").alias("mean")).first()
    if stats["least"] is not None and stats["least"] <= 0:
        raise ValueError("weights must be above 0")
    delta = delta or stats["mean"] or 1.0
    zero = F.lit(0).cast(kinds["w"])
    first = sources.where("node IS NOT NULL").select("node").distinct()
    now = materialize(first.select("node", zero.alias("distance"), F.col("node").alias("source"), F.lit(True).alias("fresh")))
    while True:
        todo = now.where("fresh").agg(F.min("distance")).first()[0]
        if todo is None:
            break
        end = (float(todo) // delta + 1) * delta  # of the nearest bucket with a node that has something to send
        sending = now.where(F.col("fresh") & (F.col("distance") < end))
        met = sending.select(F.col("node").alias("src"), "distance", "source").join(e, "src")
        far = met.select(F.col("dst").alias("node"), (F.col("distance") + F.col("w")).alias("distance"), "source")
        far = far if limit is None else far.where(F.col("distance") <= limit)
        got = far.groupBy("node").agg(F.min(F.struct("distance", "source")).alias("g"))
        own = F.when(F.col("distance").isNotNull(), F.struct("distance", "source"))
        best = F.least(own, F.col("g"))
        both = now.join(got, "node", "full_outer").select("node", own.alias("own"), best.alias("best"), (F.col("fresh") & (F.col("distance") >= end)).alias("waits"))
        new = both.select("node", "best.distance", "best.source", (F.coalesce(F.col("best") < F.col("own"), F.col("own").isNull()) | F.coalesce("waits", F.lit(False))).alias("fresh"))
        last, now = now, materialize(new)
        release(last)
    at = now.select(F.col("node").alias("src"), F.col("distance").alias("before"), F.col("source").alias("from"))
    ways = e.join(at, "src").select(F.col("dst").alias("node"), (F.col("before") + F.col("w")).alias("distance"), F.col("from").alias("source"), F.col("src").alias("parent"))
    parent = ways.join(now.select("node", "distance", "source"), ["node", "distance", "source"]).groupBy("node").agg(F.min("parent").alias("parent"))
    found = now.join(parent, "node", "left")
    return found.select("node", "distance", "source", F.when(F.col("distance") > 0, F.col("parent")).alias("parent"))


def traced(found: DataFrame, targets: DataFrame) -> DataFrame:
    """(node, path): the nodes from the source to each target (node) that was reached, by doubling the steps back."""
    now = materialize(found.select("node", F.col("parent").alias("up"), F.array("node").alias("path")))
    wanted = targets.select("node").distinct()
    while True:
        seen = Observation()
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"))
        new = now.join(above, "up", "left").select("node", F.col("next").alias("up"), F.concat(F.coalesce("before", F.expr("slice(path, 1, 0)")), "path").alias("path"))
        last, now = now, materialize(new.observe(seen, F.count("up").alias("n")))
        release(last)
        if not seen.get["n"]:
            return now.join(wanted, "node", "left_semi").select("node", "path")
