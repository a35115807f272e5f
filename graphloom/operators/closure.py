"""How many nodes each node of a directed graph reaches, as bit sets over the components.

Nodes are numbered so that those of a component follow each other. A component's set is a bitmap for each 32,768 numbers of which it has
any (Spark's bitmap aggregates): its own nodes, and the union of the sets of the components that it depends on.
Layers are built from the lowest up, so each set is made once, from sets that are final. BUCKETS bitmaps of
targets are taken at a time: what is kept on shared storage is at most a bitmap for each of these and component, and usually far less, as
only those with a bit are rows and bits of one component lie together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.condense import dependencies, scc_layers
from graphloom.operators.relational import dense_ids
from graphloom.operators.scratch import materialize, release

#: Bitmaps of targets that one pass holds for each component.
BUCKETS = 8
#: Layers whose files are read one by one before they are written together.
TOGETHER = 16


def closure_counts(edges: DataFrame) -> DataFrame:
    """(node, n): how many other nodes each node reaches, of those that reach any."""
    e = materialize(edges.select("src", "dst").where("src <> dst").distinct())
    found = materialize(scc_layers(e))
    needs = materialize(dependencies(e, found))
    numbered = dense_ids(found.select("component", "node"), ["component", "node"], "row").withColumn("row", F.col("row") + 1)
    bits = materialize(
        numbered.groupBy("component", F.expr("bitmap_bucket_number(row)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(row))").alias("bits"))
    )
    at = materialize(found.groupBy("component").agg(F.max("layer").alias("layer")))
    top = at.agg(F.max("layer")).first()[0]
    if top is None:
        return found.select("node", F.lit(0).cast("bigint").alias("n")).limit(0)
    last = bits.agg(F.max("bucket")).first()[0]
    counts = []
    for first in range(1, last + 1, BUCKETS):
        own = bits.where((F.col("bucket") >= first) & (F.col("bucket") < first + BUCKETS))
        done: list[DataFrame] = []
        for layer in range(top + 1):
            here = at.where(F.col("layer") == layer).select("component")
            sets = own.join(here, "component", "left_semi")
            if done:
                below = reduce(DataFrame.unionAll, done).withColumnRenamed("component", "dst")
                wanted = needs.join(here.withColumnRenamed("component", "src"), "src", "left_semi")
                met = wanted.join(below, "dst").select(F.col("src").alias("component"), "bucket", "bits")
                sets = sets.unionAll(met).groupBy("component", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
            done.append(materialize(sets))
            if len(done) == TOGETHER:
                old, done = done, [materialize(reduce(DataFrame.unionAll, done))]
                for x in old:
                    release(x)
        each = reduce(DataFrame.unionAll, done).groupBy("component").agg(F.sum(F.expr("bitmap_count(bits)")).alias("n"))
        counts.append(materialize(each))
        for x in done:
            release(x)
    total = reduce(DataFrame.unionAll, counts).groupBy("component").agg((F.sum("n") - 1).alias("n"))
    return found.join(total, "component").select("node", "n").where("n > 0")
