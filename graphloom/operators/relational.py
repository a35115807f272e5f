"""Relational operators of the engine: joins, aggregates, windows and ranking, as functions on DataFrames.

Ranked results carry a total order; capped ones come with the uncapped total.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.scratch import materialize

# -- joins of tables that grow


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join of which neither side is broadcast, as both grow with the input.

    Spark takes a table for as large as its files, and for no larger after an explode, so by its own choice it may
    send millions of rows through the driver.
    """
    return df.hint("merge")


# -- ranking and paging


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a totally ordered result with `total` and `truncated` on each row."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > offset + limit)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def capped_with_floor(df: DataFrame, kind: str, order: list[Column], cap: int, floor: int) -> DataFrame:
    """The first `cap` rows, and as many of each kind as make `floor` of it.

    Only the first max(cap, floor) rows of a kind can qualify; they are cut out first, kind by kind, so the overall
    rank is taken over few rows.
    """
    own = top_per_group(df, [kind], order, max(cap, floor), "kind_rank")
    ranked = own.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.where((F.col("rank") <= cap) | (F.col("kind_rank") <= floor))


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return top_per_group(df, key, order, 1, "_n").drop("_n")


def dense_ids(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Row numbers from 0 in a total order, without one task sorting all rows.

    Rows are sorted by range; each partition's offset is the sum of the counts before it, one number a partition. The
    ranges are drawn from a sample, so the rows are written with their places before they are counted: drawn again, or
    coalesced otherwise, the ranges of the counts would not be those of the rows.
    """
    cols = df.columns
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = ranged.withColumn("_p", F.spark_partition_id())
    numbered = materialize(local.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order))))
    counts = numbered.groupBy("_p").agg(F.max("_i").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_p", F.coalesce(before, F.lit(0)).alias("_o"))
    return numbered.join(F.broadcast(offsets), "_p").select(
        *cols, (F.col("_o") + F.col("_i") - 1).cast("bigint").alias(name)
    )


def strict_argmax(df: DataFrame, key: list[str], score: str) -> DataFrame:
    """The row with the greatest score of each key; keys whose greatest score is tied are left out."""
    w = Window.partitionBy(*key)
    top = df.withColumn("_m", F.max(score).over(w)).where(F.col(score) == F.col("_m"))
    return top.withColumn("_n", F.count("*").over(w)).where("_n = 1").drop("_m", "_n")


def unambiguous(df: DataFrame, key: str, target: str) -> DataFrame:
    """(key, target) of the keys with exactly one distinct target."""
    return (
        df.groupBy(key)
        .agg(F.min(target).alias(target), F.max(target).alias("_top"))
        .where(F.col(target) == F.col("_top"))
        .drop("_top")
    )


# -- degrees and roll-ups


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out, total) of each node with an edge."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(
        edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    return ends.groupBy("node").agg(
        F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.sum(F.col("i") + F.col("o")).alias("total")
    )


def module_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """File edges counted by (source module, target module), without those inside one. modules: (node, module)."""
    s = modules.select(F.col("node").alias("src"), F.col("module").alias("sm"))
    d = modules.select(F.col("node").alias("dst"), F.col("module").alias("dm"))
    return edges.join(shuffled(s), "src").join(shuffled(d), "dst").where("sm <> dm").groupBy("sm", "dm").agg(F.count("*").alias("weight"))


def coupling(rolled: DataFrame) -> DataFrame:
    """Afferent and efferent coupling of each module and its instability, null where it has neither."""
    out = rolled.groupBy(F.col("sm").alias("module")).agg(F.count_distinct("dm").alias("ce"))
    into = rolled.groupBy(F.col("dm").alias("module")).agg(F.count_distinct("sm").alias("ca"))
    both = into.join(out, "module", "full_outer").select(
        "module", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce")
    )
    return both.withColumn("instability", instability(F.col("ca"), F.col("ce")))


def instability(ca: Column, ce: Column) -> Column:
    return F.when(ca + ce > 0, F.round(ce / (ca + ce), 3))


def bucket(value: Column, floors: list[int]) -> Column:
    """The greatest floor at or below a value; null below the first."""
    return reduce(lambda c, f: F.when(value >= f, F.lit(f)).otherwise(c), floors, F.lit(None).cast("int"))


def histogram(df: DataFrame, value: Column, floors: list[int]) -> DataFrame:
    """(floor, n) for each bucket with a row."""
    return df.groupBy(bucket(value, floors).alias("floor")).agg(F.count("*").alias("n"))


def time_buckets(df: DataFrame, ts: str, minutes: int, kind: str) -> DataFrame:
    """(bucket, kind, n) over tumbling buckets, with zeros where a kind has none between its first and last."""
    width = minutes * 60
    at = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / width) * width)
    counted = df.groupBy(at.alias("bucket"), kind).agg(F.count("*").alias("n"))
    span = counted.groupBy(kind).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    step = F.expr(f"interval {minutes} minutes")
    spine = span.select(kind, F.explode(F.sequence("a", "b", step)).alias("bucket"))
    return spine.join(counted, ["bucket", kind], "left").select("bucket", kind, F.coalesce("n", F.lit(0)).alias("n"))


def component_rollup(paths: DataFrame, path: str, depth: int) -> DataFrame:
    """(component, n) of path prefixes of at most `depth` segments."""
    prefix = F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")
    return paths.groupBy(prefix.alias("component")).agg(F.count("*").alias("n"))


# -- joins


def priority_lookup(keys: DataFrame, candidates: DataFrame, key: str, target: str, prio: str) -> DataFrame:
    """Each key with its target of the best priority; a best priority with several targets resolves to none."""
    met = keys.join(candidates, key)
    best = met.groupBy(key).agg(F.min(F.struct(prio, target)).alias("a"), F.min(prio).alias("p"))
    top = met.join(best, key).where(F.col(prio) == F.col("p")).groupBy(key).agg(F.max(target).alias("b"))
    return best.join(top, key).where(F.col(f"a.{target}") == F.col("b")).select(
        key, F.col(f"a.{target}").alias(target), F.col(f"a.{prio}").alias(prio)
    )


def suffix_join(specs: DataFrame, paths: DataFrame, spec: str, path: str, most: int = 16) -> DataFrame:
    """Paths that end in "/" + spec, found by their last segment: (spec, path, n, resolved).

    One match resolves; of several, the first `most` are returned as possible ones.
    """
    last = F.substring_index
    left = specs.select(spec).distinct().withColumn("_b", last(spec, "/", -1))
    right = paths.select(path).distinct().withColumn("_b", last(path, "/", -1))
    met = left.join(right, "_b").where(
        (F.col(path) == F.col(spec)) | F.endswith(F.col(path), F.concat(F.lit("/"), F.col(spec)))
    )
    counted = met.join(met.groupBy(spec).agg(F.count("*").alias("n")), spec)
    ranked = top_per_group(counted, [spec], [F.col(path)], most, "_r")
    return ranked.select(spec, path, "n", (F.col("n") == 1).alias("resolved"))


def prefixes(path: Column) -> Column:
    """All directory prefixes of a path, the path itself and the root ("") included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def longest_prefix_join(paths: DataFrame, owners: DataFrame, path: str, root: str) -> DataFrame:
    """Each path with the deepest owner directory that holds it: its prefixes are joined on equality."""
    spread = paths.select(path, F.explode(prefixes(F.col(path))).alias(root))
    met = spread.join(owners.select(root).distinct(), root)
    return met.groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))


def containment_join(inner: DataFrame, outer: DataFrame, key: list[str]) -> DataFrame:
    """Each inner span (id, a, b) with the tightest outer span of its key that encloses it.

    Spans: columns id, a, b. Result: key, id, outer_id.
    """
    o = outer.select(*key, F.col("id").alias("outer_id"), F.col("a").alias("oa"), F.col("b").alias("ob"))
    met = inner.join(o, key).where("oa <= a AND b <= ob AND (oa < a OR b < ob)")
    tight = F.min_by("outer_id", F.struct(F.col("ob") - F.col("oa"), "oa", "outer_id"))
    return met.groupBy(*key, "id").agg(tight.alias("outer_id"))


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs that point at each other, each once: (a, b) with a < b."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_semi").where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among nodes (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(
        nodes.select(F.col("node").alias("dst")), "dst", "left_semi"
    )


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change) of rows added, modified or deleted between two snapshots."""
    o, n = old.select(key, F.col(value).alias("_o")), new.select(key, F.col(value).alias("_n"))
    met = o.withColumn("_in_o", F.lit(True)).join(n.withColumn("_in_n", F.lit(True)), key, "full_outer")
    change = (
        F.when(F.col("_in_o").isNull(), "added")
        .when(F.col("_in_n").isNull(), "deleted")
        .when(~F.col("_o").eqNullSafe(F.col("_n")), "modified")
    )
    return met.select(key, change.alias("change")).where("change IS NOT NULL")
