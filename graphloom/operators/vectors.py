"""Vector operators on array columns. Sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def nearest(df: DataFrame, vector: str, query: list[float], k: int, key: str) -> DataFrame:
    """(key, score) of the k rows of greatest dot product, by key among equals; other dimensions don't take part."""
    q = F.array(*(F.lit(float(x)) for x in query))
    fits = df.where(F.size(vector) == len(query))
    scored = fits.select(key, dot(doubles(F.col(vector)), q).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), F.asc(key)).limit(k)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, centroid): the mean of each group's vectors, at unit length."""
    flat = df.select(group, F.posexplode(doubles(F.col(vector))).alias("i", "x"))
    dims = flat.groupBy(group, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    mean = dims.groupBy(group).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("d")
    )
    return mean.select(group, "n", normalise(F.col("d.x")).alias("centroid"))


def edge_distances(edges: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """The edges with 1 - dot of their ends' vectors."""
    v = vectors.select(key, doubles(F.col(vector)).alias("_v"))
    s = v.withColumnsRenamed({key: "src", "_v": "_s"})
    d = v.withColumnsRenamed({key: "dst", "_v": "_d"})
    met = edges.join(s, "src").join(d, "dst")
    return met.withColumn("distance", 1 - dot(F.col("_s"), F.col("_d"))).drop("_s", "_d")


def kmeans(df: DataFrame, key: str, vector: str, k: int, rounds: int) -> DataFrame:
    """(key, cluster, distance): Lloyd's rounds from the vectors of the `k` least keys; of equal distances the smaller number.

    Only the `k` centres are on the driver. A centre without vectors stays. Vectors that are null, of another size than the first
    one's or have a null component are left out.
    """
    first = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).orderBy(key).limit(k).select(doubles(F.col(vector)).alias("v")).collect()
    if not first:
        return df.select(key, F.lit(0).alias("cluster"), F.lit(0.0).alias("distance")).limit(0)
    size = len(first[0]["v"])
    centres = [list(r["v"]) for r in first if len(r["v"]) == size and None not in r["v"]]
    kept = df.select(key, doubles(F.col(vector)).alias("v")).where((F.size("v") == size) & F.forall("v", lambda x: x.isNotNull()))

    def nearest_centre() -> DataFrame:
        def away(c: list[float]) -> Column:
            return F.aggregate(F.zip_with("v", F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)

        best = F.least(*[F.struct(away(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]) if len(centres) > 1 else F.struct(away(centres[0]).alias("distance"), F.lit(0).alias("cluster"))
        return kept.select(key, "v", best.alias("best")).select(key, "v", "best.cluster", "best.distance")

    for _ in range(rounds):
        means = nearest_centre().groupBy("cluster").agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(size)])
        for r in means.collect():  # k rows
            centres[r["cluster"]] = [r[f"m{i}"] for i in range(size)]
    return nearest_centre().select(key, "cluster", "distance")


def census(assigned: DataFrame, group: str, marked: str) -> DataFrame:
    """(cluster, n, dominant, purity, share) of rows (cluster, group, marked boolean): the group with most members, the least of
    equals, its share of the cluster, and the share of marked rows."""
    counted = assigned.groupBy("cluster", group).agg(F.count("*").alias("n"), F.count_if(F.expr(marked)).alias("m"))
    most = F.max(F.struct("n", (-F.col(group)).alias("o")))
    each = counted.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), most.alias("top"))
    return each.select("cluster", "n", (-F.col("top.o")).alias("dominant"), (F.col("top.n") / F.col("n")).alias("purity"), (F.col("m") / F.col("n")).alias("share"))
