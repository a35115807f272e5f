"""Components, layers, cycles and reachable sets against plain versions on chains, rings, bushes and random graphs."""

import random

import pytest

from graphloom.operators import closure
from graphloom.operators.condense import components, cycles, layers, scc_layers


def plain(edges):
    nodes = sorted({x for e in edges for x in e})
    reach = {}
    for x in nodes:
        seen, todo = {x}, [x]
        while todo:
            y = todo.pop()
            for a, b in edges:
                if a == y and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[x] = seen
    comp = {x: min(y for y in reach[x] if x in reach[y]) for x in nodes}
    size = {x: sum(comp[y] == comp[x] for y in nodes) for x in nodes}
    layer = {}

    def at(x):
        if x not in layer:
            below = {y for y in reach[x] if comp[y] != comp[x]}
            layer[x] = 1 + max(map(at, below)) if below else 0
        return layer[x]

    return {x: (comp[x], size[x], at(x)) for x in nodes}, {x: len(reach[x]) - 1 for x in nodes if len(reach[x]) > 1}


def shuffled(n, seed):
    names = list(range(n))
    random.Random(seed).shuffle(names)
    return names


def graphs():
    r = random.Random(7)
    yield "micro", [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 6), (7, 5)]
    name = shuffled(30, 1)
    tail = [(name[i], name[i + 1]) for i in range(12, 18)] + [(name[17], name[3])]
    yield "ring and tail", [(name[i], name[(i + 1) % 12]) for i in range(12)] + tail
    yield "rings in a row", [(10 * k + i, 10 * k + (i + 1) % 5) for k in range(4) for i in range(5)] + [(10 * k, 10 * k + 12) for k in range(3)]
    yield "random", list({(r.randint(0, 25), r.randint(0, 25)) for _ in range(34)})


@pytest.mark.parametrize("name, edges", list(graphs()))
def test_against_plain(spark, name, edges):
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    want, reach = plain(edges)
    assert {r.node: (r.component, r["size"], r.layer) for r in scc_layers(df).collect()} == want
    assert {r.node: r.n for r in closure.closure_counts(df).collect()} == reach
    rings = {c: s for c, s, _ in want.values() if s > 1} | {a: want[a][1] for a, b in edges if a == b and want[a][1] == 1}
    assert {r.component: r["size"] for r in cycles(df).collect()} == rings


def test_closure_in_blocks(spark, monkeypatch):
    """More bitmaps than a pass holds, and more layers than are read one by one."""
    monkeypatch.setattr(closure, "BUCKETS", 1)
    monkeypatch.setattr(closure, "TOGETHER", 2)
    n = 40_000
    star = [(0, i) for i in range(1, n)] + [(n + k + 1, n + k) for k in range(5)] + [(n, 0)]
    got = {r.node: r.n for r in closure.closure_counts(spark.createDataFrame(star, "src bigint, dst bigint")).collect()}
    assert got == {0: n - 1, n: n, **{n + k + 1: n + k + 1 for k in range(5)}}


def test_strings_nulls_and_none(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), (None, "a"), ("c", None), ("d", "a")], "src string, dst string")
    assert {(r.node, r.component) for r in components(df).collect()} == {("a", "a"), ("b", "a"), ("d", "d")}
    none = df.limit(0)
    assert components(none).collect() == [] == scc_layers(none).collect() == cycles(none).collect()
    assert closure.closure_counts(none).collect() == []


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    from graphloom.operators import condense

    n, rounds = 3_000, []
    real = condense._write
    monkeypatch.setattr(condense, "_write", lambda df, changed: rounds.append(changed) or real(df, changed))
    df = spark.range(n - 1).selectExpr("id + 1 AS src", "id AS dst")
    got = layers(df, spark.range(n).selectExpr("id AS node"))
    assert got.where("layer <> node").count() == 0 and len(rounds) < 20
