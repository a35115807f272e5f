"""Components, layers and reachable sets of a directed graph, piece by piece.

Nodes that are connected in any direction are one piece, found in rounds (`components`). Pieces of up to PIECE edges go whole to a task,
which takes many of them one after the other and holds no more than a piece and a batch; edges of larger ones go through the rounds of
`condense` and `closure`, which hold none. Graphs of many small pieces thus cost the rounds of one search for pieces, however many layers
they have.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import closure, condense
from graphloom.operators.components import connected_components
from graphloom.operators.relational import shuffled
from graphloom.operators.scratch import materialize, release

#: Edges of the largest piece that a task takes whole: its sets are at most 34 MB.
PIECE = 1 << 14


def _solve(src: list, dst: list, piece: list, counted: bool) -> list[tuple]:
    """(node, component, size, layer, n) of the nodes of whole pieces, by depth-first search; n: other nodes reached, if counted.

    A component is closed after all that it depends on, so its layer and its set of nodes are made from final ones.
    """
    code: dict = {}
    names, base, out = [], [], []
    first, last = 0, None
    for s, d, p in zip(src, dst, piece):
        if p != last:
            first, last = len(names), p
        for x in (s, d):
            if x not in code:
                code[x] = len(names)
                names.append(x)
                base.append(first)
                out.append([])
        out[code[s]].append(code[d])
    seen, low, comp = [0] * len(names), [0] * len(names), [-1] * len(names)
    found: list[tuple] = []  # component, size, layer, n
    sets: list[int] = []
    clock, open_ = 0, []
    for root in range(len(names)):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        open_.append(root)
        path = [(root, iter(out[root]))]
        while path:
            v, rest = path[-1]
            for w in rest:
                if not seen[w]:
                    clock += 1
                    seen[w] = low[w] = clock
                    open_.append(w)
                    path.append((w, iter(out[w])))
                    break
                if comp[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
            else:
                path.pop()
                if path:
                    u = path[-1][0]
                    low[u] = min(low[u], low[v])
                if low[v] == seen[v]:
                    c, layer, bits, members = len(found), 0, 0, []
                    while comp[v] < 0:
                        w = open_.pop()
                        members.append(w)
                        comp[w] = c
                        if counted:
                            bits |= 1 << (w - base[w])
                    for w in members:
                        for x in out[w]:
                            if comp[x] != c:
                                layer = max(layer, found[comp[x]][2] + 1)
                                if counted:
                                    bits |= sets[comp[x]]
                    sets.append(bits if counted else 0)
                    found.append((min(names[w] for w in members), len(members), layer, bits.bit_count() - 1))
    return [(x, *found[c]) for x, c in zip(names, comp)]


def _whole_pieces(batches: Iterator[pa.RecordBatch], counted: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece to the answers of the pieces in them, a batch and the piece that it cuts at a time."""
    kind, held = None, ([], [], [])

    def answers(rows: tuple) -> pa.RecordBatch:
        columns = list(zip(*_solve(*rows, counted))) or [()] * 5
        kinds = [kind, kind, pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "component", "size", "layer", "n"])

    for batch in batches:
        kind = batch.column("src").type
        held = tuple(a + batch.column(c).to_pylist() for a, c in zip(held, ("src", "dst", "piece")))
        pieces = held[2]
        cut = len(pieces)
        while cut and pieces[cut - 1] == pieces[-1]:  # the last one may go on in the next batch
            cut -= 1
        if cut:
            yield answers(tuple(a[:cut] for a in held))
            held = tuple(a[cut:] for a in held)
    if held[0]:
        yield answers(held)


def _by_pieces(edges: DataFrame, counted: bool) -> tuple[DataFrame, DataFrame | None]:
    """(node, component, size, layer, n) of small pieces, and the edges of the others, if there are any."""
    e = materialize(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    ends = connected_components(e).select(F.col("id").alias("src"), "component")
    met = e.join(shuffled(ends), "src", "left")  # nodes that point at themselves alone have no piece
    tagged = materialize(met.select("src", "dst", F.coalesce("component", "src").alias("piece")))
    release(e)
    large = materialize(tagged.groupBy("piece").agg(F.count("*").alias("_n")).where(F.col("_n") > PIECE).select("piece"))
    small, rest = tagged, None
    if not large.isEmpty():
        small = tagged.join(shuffled(large), "piece", "left_anti")
        rest = materialize(tagged.join(shuffled(large), "piece", "left_semi").select("src", "dst"))
    kind = dict(tagged.dtypes)["src"]
    dealt = small.select("src", "dst", "piece").repartition("piece").sortWithinPartitions("piece")
    schema = f"node {kind}, component {kind}, size bigint, layer bigint, n bigint"
    found = materialize(dealt.mapInArrow(lambda b: _whole_pieces(b, counted), schema))
    release(tagged)
    return found, rest


def scc_layers(edges: DataFrame) -> DataFrame:
    """(node, component, size, layer) as `condense.scc_layers` gives them."""
    found, rest = _by_pieces(edges, counted=False)
    columns = ["node", "component", "size", "layer"]
    return found.select(columns) if rest is None else found.select(columns).unionByName(condense.scc_layers(rest).select(columns))


def closure_counts(edges: DataFrame) -> DataFrame:
    """(node, n) as `closure.closure_counts` gives them."""
    found, rest = _by_pieces(edges.where("src <> dst"), counted=True)
    out = found.where("n > 0").select("node", "n")
    return out if rest is None else out.unionByName(closure.closure_counts(rest))


def cycles(edges: DataFrame) -> DataFrame:
    """(component, size) of components of more than one node, and of nodes that point at themselves."""
    parts = scc_layers(edges).groupBy("component").agg(F.count("*").alias("size"))
    own = edges.where("src = dst").select(F.col("src").alias("component")).distinct()
    return parts.join(shuffled(own.withColumn("own", F.lit(True))), "component", "left").where("size > 1 OR own").select("component", "size")
