"""Forests and weighted paths against plain versions."""

import heapq
import random

import pytest

from graphloom.operators import forest, paths


def plain_forest(edges, score):
    into, out = {}, {}
    for a, b in edges:
        into.setdefault(b, set()).add(a)
        out.setdefault(a, set()).add(b)
    nodes = {x for e in edges for x in e}
    parent = {a: max(out[a] - {a}, key=lambda b: (score[b], len(into.get(b, ())), -len(out.get(b, ())), b)) for a in out if out[a] - {a}}
    cut = {}
    for x in sorted(nodes):
        seen = []
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x in seen:
            ring = seen[seen.index(x) :]
            c = max(ring, key=lambda y: (score[y], len(into.get(y, ())), y))
            cut[c] = parent.pop(c)
    kids = {}
    for a, b in parent.items():
        kids.setdefault(b, []).append(a)

    def demand(x):
        return sum(map(demand, kids[x])) if x in kids else 1

    return {x: (parent.get(x), cut.get(x), demand(x)) for x in nodes}


@pytest.mark.parametrize("seed, n, m", [(1, 12, 30), (2, 30, 40), (4, 25, 60)])
def test_forest(spark, seed, n, m):
    r = random.Random(seed)
    edges = sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)} - {(x, x) for x in range(n)})
    score = {x: r.choice([1.0, 2.0, 3.0]) for x in range(n)}
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    none = spark.createDataFrame([], "node bigint, n bigint")
    degree = forest.support_scores(e, none).drop("support")
    scores = degree.join(spark.createDataFrame(list(score.items()), "node bigint, support double"), "node")
    want = plain_forest(edges, score)
    assert {r.node: (r.parent, r.cut, r.demand) for r in forest.forest(e, scores).collect()} == want
    assert any(c is not None for _, c, _ in want.values())


def test_chain_and_bush(spark):
    n = 500
    chain = [(i + 1, i) for i in range(n)] + [(n + 1 + i, n) for i in range(200)]
    p = spark.createDataFrame(chain, "node bigint, parent bigint")
    got = forest.subtree_sums(p, spark.createDataFrame([(i, 1) for i in range(n + 201)], "node bigint, value bigint"))
    assert {r.node: r.total for r in got.collect()} == {i: n + 201 - i if i <= n else 1 for i in range(n + 201)}
    assert forest.cycle_cuts(p, p.selectExpr("node", "1.0 AS support", "1 AS n_in")).collect() == []


def test_support(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (2, 4)], "src bigint, dst bigint")
    reached = spark.createDataFrame([(2, 2), (4, 3)], "node bigint, n bigint")
    tests = spark.createDataFrame([(3,)], "node bigint")
    got = {r.node: r.support for r in forest.support_scores(e, reached, tests).collect()}
    assert got[2] == pytest.approx(1 + 2 * 1.0986122886 + 1.0986122886 + 0.25 * 0.6931471806, abs=1e-8)
    assert got[3] == pytest.approx(1 + 0.25 * 0.6931471806 - 0.35, abs=1e-8)


def plain_paths(edges, sources, limit):
    out = {}
    for a, b, w in edges:
        if None not in (a, b, w):
            out.setdefault(a, []).append((b, w))
    best = {s: (0, s) for s in sources}
    todo = [(0, s, s) for s in sources]
    while todo:
        d, s, x = heapq.heappop(todo)
        if best.get(x) != (d, s):
            continue
        for y, w in out.get(x, ()):
            if (limit is None or d + w <= limit) and (y not in best or (d + w, s) < best[y]):
                best[y] = (d + w, s)
                heapq.heappush(todo, (d + w, s, y))
    ways = {}
    for a, b, w in edges:
        if w is not None and a in best and b in best and best[b][0] and best[b] == (best[a][0] + w, best[a][1]):
            ways[b] = min(ways.get(b, a), a)
    return {x: (d, s, ways.get(x)) for x, (d, s) in best.items()}


@pytest.mark.parametrize("delta, limit", [(None, None), (2, None), (100, None), (3, 9)])
def test_shortest_paths(spark, delta, limit):
    r = random.Random(6)
    edges = [(r.randrange(40), r.randrange(40), r.randint(1, 9)) for _ in range(120)] + [(None, 3, 1), (3, None, 1), (3, 4, None)]
    edges += [(50 + i, 51 + i, 1) for i in range(8)] + [(2, 50, 1)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint, w bigint")
    sources = spark.createDataFrame([(0,), (2,), (2,), (99,), (None,)], "node bigint")
    found = paths.shortest_paths(df, sources, delta, limit)
    want = plain_paths(edges, [0, 2, 99], limit)
    assert {r.node: (r.distance, r.source, r.parent) for r in found.collect()} == want
    if limit is None:
        ways = {r.node: r.path for r in paths.traced(found, found.select("node")).collect()}
        for x, (d, s, _) in want.items():
            p = ways[x]
            assert p[0] == s and p[-1] == x and all(want[b][2] == a for a, b in zip(p, p[1:]))


def test_weights_above_zero(spark):
    df = spark.createDataFrame([(1, 2, 0)], "src bigint, dst bigint, w bigint")
    with pytest.raises(ValueError, match="above 0"):
        paths.shortest_paths(df, spark.createDataFrame([(1,)], "node bigint"))
    none = paths.shortest_paths(df.limit(0), spark.createDataFrame([(1,)], "node bigint"))
    assert [tuple(r) for r in none.collect()] == [(1, 0, 1, None)]
