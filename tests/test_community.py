"""Communities, co-changes, betweenness and k-means against plain versions."""

import random
from collections import Counter, deque

import pytest

from graphloom.operators import community
from graphloom.operators import vectors as v


def graph(seed, n, m):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


def test_communities(spark):
    edges = graph(3, 30, 50)
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    now = {x: x for x in near}
    for _ in range(4):
        counts = {x: Counter(now[y] for y in near[x]) for x in near}
        now = {x: min(c, key=lambda k: (-c[k], k)) for x, c in counts.items()}
    got = community.communities(spark.createDataFrame([*edges, (None, 1), (1, None)], "src int, dst int"), 4)
    assert {r.node: r.community for r in got.collect()} == now


def brandes(edges, sources):
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, []).append(b)
    score = Counter()
    for s in sources:
        depth, paths, order, before, todo = {s: 0}, Counter({s: 1}), [], {}, deque([s])
        while todo:
            x = todo.popleft()
            order.append(x)
            for y in out.get(x, ()):
                if y not in depth:
                    depth[y] = depth[x] + 1
                    todo.append(y)
                if depth[y] == depth[x] + 1:
                    paths[y] += paths[x]
                    before.setdefault(y, []).append(x)
        rest = Counter()
        for y in reversed(order):
            for x in before.get(y, ()):
                rest[x] += paths[x] / paths[y] * (1 + rest[y])
            if y != s:
                score[y] += rest[y]
    return {x: pytest.approx(n) for x, n in score.items() if n > 0}


@pytest.mark.parametrize("n, m, sources", [(15, 40, range(15)), (25, 30, [0, 3, 99])])
def test_betweenness(spark, n, m, sources):
    edges = graph(n, n, m)
    df = spark.createDataFrame(edges, "src int, dst int")
    got = community.betweenness(df, spark.createDataFrame([(x,) for x in sources], "node int"))
    assert {r.node: r.score for r in got.collect()} == brandes(edges, sources)
    assert community.betweenness(df.limit(0), df.selectExpr("src AS node")).collect() == []


def test_co_changes(spark):
    rows = [(c, f) for c, fs in enumerate(["ab", "abc", "bc", "abz", "d", "dd"]) for f in fs] + [(None, "a"), (1, None)]
    got = community.co_changes(spark.createDataFrame(rows, "c int, f string"), "c", "f", 2).collect()
    assert {(r.a, r.b): (r.n, r.lift) for r in got} == {("a", "b"): (3, 3 * 6 / (3 * 4)), ("b", "c"): (2, 2 * 6 / (4 * 2))}


def test_kmeans(spark):
    rows = [(0, [0.0, 0.0]), (1, [10.0, 0.0]), (2, [1.0, 0.0]), (3, [9.0, 1.0]), (4, [0.0, 1.0]), (5, None), (6, [1.0]), (7, [None, 1.0]), (None, [5.0, 0.0])]
    got = v.kmeans(spark.createDataFrame(rows, "id int, x array<double>"), "id", "x", 2, 5)
    assert {(r.id, r.cluster) for r in got.collect()} == {(0, 0), (2, 0), (4, 0), (1, 1), (3, 1), (None, 0)}
    assert v.kmeans(spark.createDataFrame([], "id int, x array<double>"), "id", "x", 2, 5).collect() == []
