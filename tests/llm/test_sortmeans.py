"""Sort-means against plain rounds over all pairs, on awkward vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from graphloom.llm import sortmeans

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster int, distance string"


def plain(rows, size, k, rounds):
    kept = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v, *_ in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else old for j, old in enumerate(c)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    part = {j: sum(d for _, d, x in found if x == j) for _, _, j in found}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return [(i, j, d, part[j], total, sha[j]) for i, d, j in found]


def vectors(n, size, seed):
    r = random.Random(seed)
    grid = [[r.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(size)] for _ in range(n)]
    rows = [(i, v, i % 3, 7, "x") for i, v in enumerate(grid)]
    rows += [(n + i, list(grid[0]), 0, 7, "x") for i in range(n // 3)]  # a third are copies of one vector
    rows += [rows[1], rows[1], (None, grid[2], 1, None, None), (-5, None, 1, 1, ""), (-6, [], 1, 1, "")]
    rows += [(-7, grid[3][:-1], 1, 1, ""), (-8, [None, *grid[3][1:]], 1, 1, ""), (-9, [float("nan"), *grid[3][1:]], 1, 1, "")]
    return [*rows, (-10, [float("inf"), *grid[3][1:]], 1, 1, ""), (-11, grid[3] + [0.0], 1, 1, "")]


@pytest.mark.parametrize("n, size, k, rounds", [(150, 4, 12, 5), (40, 3, 200, 3), (60, 64, 40, 5), (30, 2, 1, 2)])
def test_sort_means(spark, n, size, k, rounds):
    rows = vectors(n, size, n)
    got = sortmeans.cluster(spark.createDataFrame(rows, SCHEMA), size=size, k=k, rounds=rounds).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows, size, k, rounds)))


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    useless = spark.createDataFrame([(1, None, 1, 1, ""), (None, [0.5] * 64, 1, 1, "")], SCHEMA)
    for df in (empty, useless):
        out = sortmeans.cluster(df)
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert out.collect() == []


def test_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e6] * 64, 1, 1, "")], SCHEMA)
    with pytest.raises(Exception, match="a component exceeds"):
        sortmeans.cluster(df).collect()


def test_scan_stops_and_ties_are_tried():
    r = np.random.default_rng(5)
    c = r.integers(-1000, 1000, (50, 2))
    x = np.concatenate([(c[r.integers(0, 50, 3000)] + r.integers(-3, 4, (3000, 2))), c, (c[:25] + c[25:]) // 2])
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    start = full.argmin(axis=1)
    best, distance, tried = sortmeans.nearest(x, start, c)
    assert (best == start).all() and (distance == full.min(axis=1)).all()
    assert tried < 0.1 * full.size  # most centroids are never looked at
    best, distance, _ = sortmeans.nearest(x, r.integers(0, 50, len(x)), c)
    assert (best == start).all() and (distance == full.min(axis=1)).all()
    # a tie exactly at twice the distance: 0 is midway between -10 and 10
    best, _, _ = sortmeans.nearest(np.array([[0]]), np.array([1]), np.array([[-10], [10]]))
    assert best[0] == 0
