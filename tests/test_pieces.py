"""Graphs solved piece by piece, held to a plain version, with pieces on both sides of the limit."""

import pytest

from graphloom.operators import closure, condense, pieces


def plain(pairs):
    """(node, component, size, layer) and (node, n) by sets."""
    nodes = {x for pair in pairs for x in pair}
    reach = {x: {x} for x in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    part = {x: {y for y in reach[x] if x in reach[y]} for x in nodes}

    def layer(x):
        return max((1 + layer(y) for y in reach[x] - part[x]), default=0)

    return sorted((x, min(part[x]), len(part[x]), layer(x)) for x in nodes), sorted((x, len(reach[x]) - 1) for x in nodes if len(reach[x]) > 1)


@pytest.mark.parametrize("kind, limit", [("bigint", pieces.PIECE), ("string", pieces.PIECE), ("bigint", 5)])
def test_pieces_equal_plain_version(spark, monkeypatch, kind, limit):
    monkeypatch.setattr(pieces, "PIECE", limit)  # with 5 one piece goes through the rounds
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (6, 5), (10, 11), (12, 11), (12, 13), (20, 20), (30, 31), (31, 30)]
    name = (lambda x: x) if kind == "bigint" else (lambda x: f"n{x:02d}")
    pairs = [(name(a), name(b)) for a, b in pairs]
    e = spark.createDataFrame([*pairs, (None, name(3)), pairs[0]], f"src {kind}, dst {kind}")
    layered, counted = plain(pairs)
    assert sorted(tuple(r) for r in pieces.scc_layers(e).select("node", "component", "size", "layer").collect()) == layered
    assert sorted(tuple(r) for r in pieces.closure_counts(e).select("node", "n").collect()) == counted


def test_small_pieces_take_no_rounds(spark, monkeypatch):
    """A chain takes as many layers as it has nodes; rounds over layers would take minutes."""

    def never(*_):
        raise AssertionError("rounds")

    monkeypatch.setattr(condense, "layers", never)
    monkeypatch.setattr(closure, "scc_layers", never)
    e = spark.range(200).selectExpr("id AS src", "id + 1 AS dst")
    got = {r.node: r.n for r in pieces.closure_counts(e).collect()}
    assert got == {i: 200 - i for i in range(200)}
    assert {r.node: r.layer for r in pieces.scc_layers(e).collect()} == {i: 200 - i for i in range(201)}


def test_batches_cut_pieces():
    import pyarrow as pa

    src, dst, piece = [1, 2, 5, 6, 7, 9], [2, 1, 6, 7, 8, 10], [1, 1, 5, 5, 5, 9]
    whole = pa.RecordBatch.from_pydict({"src": src, "dst": dst, "piece": piece})
    for step in (1, 2, 4, 6):
        cut = [whole.slice(i, step) for i in range(0, 6, step)]
        out = [tuple(r.values()) for b in pieces._whole_pieces(iter(cut), True) for r in b.to_pylist()]
        assert sorted(out) == [(1, 1, 2, 0, 1), (2, 1, 2, 0, 1), (5, 5, 1, 3, 3), (6, 6, 1, 2, 2), (7, 7, 1, 1, 1), (8, 8, 1, 0, 0), (9, 9, 1, 1, 1), (10, 10, 1, 0, 0)]
