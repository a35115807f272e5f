"""Similarity joins of sets: which groups have item sets that are alike, and which items share groups.

Groups with equal sets are one class, found by sums of hashes that are added up before they are shuffled, so that however
many groups are equal, one of them is compared. A class is known by the size of its set and 124 bits of hash.

Classes meet on their prefixes alone (Chaudhuri et al., 2006; Xiao et al., "PPJoin", 2008; Wang et al., "AdaptJoin", 2012):
with items in the order of their rarity, two sets of Jaccard t or more share `l` of the first n - ceil(t n) + l items of
either. Their keys are all choices of l of these items. l is as large as KEYS choices a set allow, so small sets
meet on many items at once, also where there are few different items in all; large sets meet on one. Sizes bound which
sets can be alike, and the places of the first item of the key bound how many items they can have in common. What is
left is counted exactly. A key that many classes have is cut into blocks, and each pair of blocks is a unit
of its own, so no task gets all of a hot key's classes.

Null groups and null items are left out, repeated rows count once.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.scratch import materialize

#: Keys of a set at most, where a key has more than one item, and items of a key.
KEYS, KEY_ITEMS = 24, 8
#: Rows of a key that meet in one unit, at most twice as many where hashes are uneven.
BLOCK = 2_048


def _blocks(rows: DataFrame, key: list[str], member: str) -> DataFrame:
    """The rows with the number of blocks that their key needs, and their own block."""
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))
    met = rows.join(sizes, key)
    return met.withColumn("_b", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))


def meet(rows: DataFrame, key: list[str], member: str, columns: list[str]) -> DataFrame:
    """Pairs of rows that share a key, with member < other member: a_<column> and b_<column>, for the member and `columns`.

    Every pair of blocks of a key is a row of the join's key, so hot keys are spread over many tasks.
    """
    cut = _blocks(rows.select(*key, member, *columns), key, member)
    left = F.sequence(F.col("_b"), F.col("_n") - 1)  # pairs of blocks (x, y) with x <= y
    right = F.sequence(F.lit(0), F.col("_b"))
    a = cut.select(*key, F.col("_b").alias("_x"), F.explode(left).alias("_y"), *[F.col(c).alias(f"a_{c}") for c in [member, *columns]])
    b = cut.select(*key, F.explode(right).alias("_x"), F.col("_b").alias("_y"), *[F.col(c).alias(f"b_{c}") for c in [member, *columns]])
    met = a.join(b, [*key, "_x", "_y"]).where((F.col("_x") < F.col("_y")) | (F.col(f"a_{member}") < F.col(f"b_{member}")))
    names = [member, *columns]
    turned = F.col(f"a_{member}") > F.col(f"b_{member}")  # blocks are by hash, so either may be the smaller
    first = [F.when(turned, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"a_{c}") for c in names]
    second = [F.when(turned, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"b_{c}") for c in names]
    return met.select(*key, *first, *second)


def set_classes(df: DataFrame, group: str, item: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, sets): (group, class, size) of groups with `least` items or more, and (class, item, size) of one set a class.

    A class is named by its least group.
    """
    once = df.select(F.col(group).alias("group"), F.col(item).alias("item")).where("group IS NOT NULL AND item IS NOT NULL").distinct()
    hashes = [F.sum(F.shiftright(F.xxhash64("item", F.lit(i)), 2).cast("decimal(38,0)")).alias(f"h{i}") for i in (0, 1)]
    known = once.groupBy("group").agg(F.count("*").alias("size"), *hashes).where(F.col("size") >= least)
    named = known.groupBy("size", "h0", "h1").agg(F.min("group").alias("class"))
    members = materialize(known.join(named, ["size", "h0", "h1"]).select("group", "class", "size"))
    first = members.where("group = class").select("group", "size")
    sets = materialize(once.join(first, "group").select(F.col("group").alias("class"), "item", "size"))
    return members, sets


def _needed(n: Column, threshold: float) -> Column:
    """The fewest items that a set as alike as that has in common with one of n items."""
    return F.ceil(n * threshold - 1e-9)


def _key_items(n: Column, threshold: float) -> Column:
    """Items of a key of a set of n: of l among those that may be missing and l more, there are KEYS choices at most."""
    missing = n - _needed(n, threshold)
    most = [max(l for l in range(1, KEY_ITEMS + 1) if l == 1 or math.comb(k + l, l) <= KEYS) for k in range(KEYS)]
    by_missing = F.coalesce(F.get(F.array(*map(F.lit, most)), missing.cast("int")), F.lit(1))
    return F.greatest(F.lit(1), F.least(by_missing, _needed(n, threshold))).cast("int")


def _keys(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, class, size, place): the keys of each class, with the place of the key's first item.

    Sets meet on keys of as many items as the smaller of their two numbers, so a set has keys of every number that a set
    alike to it may have, up to its own.
    """
    rarity = sets.groupBy("item").agg(F.count("*").alias("df"))
    order = Window.partitionBy("class").orderBy("df", "item")
    placed = sets.join(rarity, "item").withColumn("place", F.row_number().over(order))
    n = F.col("size")
    own = _key_items(n, threshold)
    least = F.least(own, _key_items(_needed(n, threshold), threshold), _key_items(F.floor(n / threshold + 1e-9), threshold))
    missing = (n - _needed(n, threshold)).cast("int")
    known = placed.select("class", "item", "size", "place", own.alias("own"), least.alias("least"), missing.alias("missing"))
    single = known.where((F.col("least") == 1) & (F.col("place") <= F.col("missing") + 1))
    several = known.where((F.col("own") > 1) & (F.col("place") <= F.col("missing") + F.col("own")))  # a few rows a class
    listed = several.groupBy("class", "size", "own", "least", "missing").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("items"))
    chosen = [
        (k, l, list(c)) for k in range(KEYS) for l in range(2, KEY_ITEMS + 1) if math.comb(k + l, l) <= KEYS for c in combinations(range(k + l), l)
    ]
    choices = sets.sparkSession.createDataFrame(chosen, "missing int, l int, at array<int>")  # fixed, some hundred rows
    met = listed.join(F.broadcast(choices), "missing").where("l <= own AND l >= least")
    key = F.xxhash64(F.transform("at", lambda i: F.get("items", i)["item"]))  # two keys of one hash add a candidate, no more
    return single.select(F.xxhash64(F.array("item")).alias("key"), "class", "size", "place").unionAll(
        met.select(key.alias("key"), "class", "size", (F.col("at")[0] + 1).alias("place"))
    )


def similar_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, na, nb, both) of classes (class, item, size) whose Jaccard is at least `threshold` (above 0), a < b."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    pairs = meet(materialize(_keys(sets, threshold)), ["key"], "class", ["size", "place"])
    na, nb = F.col("a_size"), F.col("b_size")
    common = 1 + F.least(na - F.col("a_place"), nb - F.col("b_place"))  # at most, if it is the first item they share
    wanted = F.ceil((na + nb) * (threshold / (1 + threshold)) - 1e-9)
    fits = (F.least(na, nb) >= _needed(F.greatest(na, nb), threshold)) & (common >= wanted)
    # the key of the first items that they share has the largest bound, so a pair is kept if that one keeps it
    found = pairs.where(fits).select(F.col("a_class").alias("a"), F.col("b_class").alias("b"), na.alias("na"), nb.alias("nb")).distinct()
    of_a = found.join(sets.select(F.col("class").alias("a"), "item"), "a")
    both = of_a.join(sets.select(F.col("class").alias("b"), "item"), ["b", "item"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    return both.where(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")) >= threshold)


def jaccard_pairs(df: DataFrame, group: str, item: str, threshold: float, least: int = 1) -> DataFrame:
    """(a, b, jaccard) of groups whose item sets are alike, a < b; groups under `least` items are left out.

    Classes are compared, and expanded to their groups last; `similar_sets` leaves them as they are.
    """
    members, links = similar_sets(df, group, item, threshold, least)
    equal = meet(members.select("class", "group"), ["class"], "group", []).select(
        F.col("a_group").alias("a"), F.col("b_group").alias("b"), F.lit(1.0).alias("jaccard")
    )
    of_a = members.select(F.col("class").alias("a"), F.col("group").alias("ga"))
    of_b = members.select(F.col("class").alias("b"), F.col("group").alias("gb"))
    alike = links.join(of_a, "a").join(of_b, "b")
    return equal.unionAll(alike.select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b"), "jaccard"))


def similar_sets(df: DataFrame, group: str, item: str, threshold: float, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, links): (group, class, size) and (a, b, jaccard) between classes with different sets."""
    members, sets = set_classes(df, group, item, least)
    found = similar_classes(sets, threshold)
    j = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return members, materialize(found.select("a", "b", j.alias("jaccard")))


def pairs_within(df: DataFrame, group: str, item: str, least: int = 2) -> DataFrame:
    """(a, b, n): items a < b that occur in n groups together, for n of `least` or more.

    Groups with equal sets are counted once and weighed; a group of very many items is cut into blocks.
    """
    members, sets = set_classes(df, group, item)
    weight = members.groupBy("class").agg(F.count("*").alias("n"))
    heavy = sets.select("class", "item").join(weight, "class")
    met = meet(heavy, ["class"], "item", ["n"])
    return met.groupBy(F.col("a_item").alias("a"), F.col("b_item").alias("b")).agg(F.sum("a_n").alias("n")).where(F.col("n") >= least)
