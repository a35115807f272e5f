"""Every registered query of the library against its SQL, on the smallest tables; the operators' micro cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as g
from graphloom.operators import relational as op
from graphloom.operators.components import connected_components
from graphloom.plans import catalog
from graphloom.plans.tables import edges as part_edges

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(columns).collect()]
    if name in catalog.ORACLES:
        r = sql.execute(catalog.ORACLES[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == columns
        assert plain(got) == plain([[row[names.index(c)] for c in columns] for row in r.fetchall()])
    else:
        assert got


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def parts(df):
    return {r.node: (r.component, r["size"], r.layer) for r in df.collect()}


def test_components(spark):
    e = edges(spark, [(i, i + 1) for i in range(1, 20)] + [(100, 101), (102, 101), (7, 7), (None, 3), (5, 4)])
    got = {r.id: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(e.limit(0)).count() == 0


def test_instability(spark):
    df = spark.createDataFrame([(0, 0), (3, 1), (0, 5), (5, 0)], "ca int, ce int")
    assert [r.i for r in df.select(op.instability(F.col("ca"), F.col("ce")).alias("i")).collect()] == [None, 0.25, 1.0, 0.0]


def test_walk_limited(spark):
    e = edges(spark, [(1, 3), (1, 2), (2, 5), (3, 4), (2, 4), (5, 6)])
    got = [(r.node, r.depth, r.truncated) for r in g.walk_limited(e, 1, 3, 4).orderBy("ord").collect()]
    assert got == [(2, 1, True), (3, 1, True), (4, 2, True), (5, 2, True)]
    assert not any(r.truncated for r in g.walk_limited(e, 1, 3, 50).collect())


def test_chain(spark):
    def order(rows):
        got = g.chain_order(spark.createDataFrame(rows, "id string, parent string")).collect()
        return [r.id for r in sorted(got, key=lambda r: r.position)]

    assert order([("c", "b"), ("a", None), ("b", "a"), ("d", "c")]) == ["a", "b", "c", "d"]
    for bad in ([("a", None), ("b", None)], [("a", None), ("b", "a"), ("c", "a")], [("a", None), ("b", "x")], [("a", "b"), ("b", "a")]):
        assert order(bad) == []


def test_whole_graph(spark, tmp_path):
    """Queries without SQL take all edges, light ones too, held to plain versions."""
    parts = [[1, 2, 3, 1], [3, 4], [4, 5, 6], [6, 5], [7, 1], [2, 2, 8]]
    made = [(o, k, p, 1.0 + 7 * (o + k)) for o, order in enumerate(parts) for k, p in enumerate(order)]
    lineitem = spark.createDataFrame(made, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double")
    lineitem.write.parquet(f"{tmp_path}/lineitem.parquet")
    e = {(a, b) for order in parts for a, b in zip(order, order[1:]) if a != b}
    nodes = sorted({x for pair in e for x in pair})
    run = {name: catalog.QUERIES[name](spark, str(tmp_path)).collect() for name in ("pagerank", "walk_limited")}
    layered = g.scc_layers(part_edges(spark, str(tmp_path))).collect()

    rank = {x: 1 / len(nodes) for x in nodes}
    out = {x: [b for a, b in e if a == x] for x in nodes}
    for _ in range(10):
        lost = sum(rank[x] for x in nodes if not out[x])
        got = {x: sum(rank[a] / len(out[a]) for a, b in e if b == x) + lost / len(nodes) for x in nodes}
        rank = {x: 0.15 / len(nodes) + 0.85 * got[x] for x in nodes}
    assert {r.node for r in run["pagerank"]} == set(nodes)
    assert all(r.rank == pytest.approx(rank[r.node], abs=1e-9) for r in run["pagerank"])

    reach = {x: {x} for x in nodes}
    for _ in nodes:
        reach = {x: reach[x].union(*(reach[y] for y in out[x])) for x in nodes}
    component = {x: min(y for y in reach[x] if x in reach[y]) for x in nodes}

    def layer(x):
        below = {y for y in reach[x] if component[y] != component[x]}
        return 1 + max(map(layer, below)) if below else 0

    assert {(r.node, r.component, r.layer) for r in layered} == {(x, component[x], layer(x)) for x in nodes}

    depth, front = {1: 0}, [1]
    for k in range(1, 5):
        front = {y for x in front for y in out[x]} - depth.keys()
        depth |= dict.fromkeys(front, k)
    assert {(r.node, r.depth) for r in run["walk_limited"]} == {(x, k) for x, k in depth.items() if k}


def test_pagerank_sums_to_one(spark):
    ranks = g.pagerank(edges(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (1, 5)])).collect()
    assert math.isclose(sum(r["rank"] for r in ranks), 1.0, abs_tol=1e-9)


def test_page_and_floor(spark):
    df = spark.range(25)
    p = op.page(df, [F.asc("id")], 10, 5).collect()
    assert [r.id for r in p] == list(range(5, 15)) and p[0].total == 25 and p[0].truncated
    kinds = df.withColumn("k", F.col("id") >= 20)
    got = {r.id for r in op.capped_with_floor(kinds, "k", [F.asc("id")], 6, 2).collect()}
    assert got == {0, 1, 2, 3, 4, 5, 20, 21}


def test_stream_changes(spark, tmp_path):
    from graphloom.plans.checks import drain
    from graphloom.streaming.windows import changes

    schema = "path string, mtime bigint, poll int, present boolean"
    polls = [[("a", 1, 0, True), ("b", 1, 0, True)], [("a", 2, 1, True), ("b", 1, 1, True), ("c", 5, 1, True)], [("a", 2, 2, True), ("b", 1, 2, False)]]
    for i, p in enumerate(polls):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del i
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {(r.path, r.mtime, r.change) for r in drain(changes(stream), spark).collect()}
    assert got == {("a", 2, "modified"), ("c", 5, "added"), ("b", 1, "deleted")}
