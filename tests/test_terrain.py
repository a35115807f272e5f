"""Projection, density and borders against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import terrain as tr


def test_groups(spark):
    paths = ["a/b/c/x.py", "a/b/y.py", "a/z.py", "w.py", "q/b/c/d/e.py", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r.g for r in df.select(tr.group_of(F.col("path"), 2).alias("g")).collect()]
    assert got == ["a/b", "a/b", "a", ".", "q/b", None]
    assert tr.auto_segments(df, "path", 5) == 8 and tr.auto_segments(df, "path", 4) == 2 and tr.auto_segments(df, "path", 3) == 1
    assert tr.auto_segments(df.limit(0), "path", 0) == 8


def test_projection(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) * [9, 5, 1, 1, 0.5, 0.1] + 1000
    bad = [(900, None), (901, [1.0]), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6)]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + bad
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(5)
    got = {r.id: r.p for r in tr.project(df, "id", "v").collect()}
    c = x - x.mean(axis=0)
    axes = np.linalg.svd(c, full_matrices=False)[2][:2]
    axes = np.array([a if a[np.abs(a).argmax()] > 0 else -a for a in axes])
    assert set(got) == set(range(300)) and np.allclose([got[i] for i in range(300)], c @ axes.T, atol=1e-6)
    assert tr.project(df.limit(0), "id", "v").collect() == []
    one = tr.project(spark.createDataFrame([(1, [2.0]), (2, [4.0])], "id bigint, v array<double>"), "id", "v").collect()
    assert {r.id: r.p for r in one} == {1: [-1.0, 0.0], 2: [1.0, 0.0]}


def plain_density(points, w, h):
    k = tr.kernel(max(1.5, min(w, h) / 50))
    r = len(k) // 2
    grid = np.zeros((w, h))
    for x, y, n in points:
        grid[min(w - 1, int(x * (w - 1))), min(h - 1, int(y * (h - 1)))] += n
    for _ in range(2):
        side = np.pad(grid, ((r, r), (0, 0)), mode="symmetric")
        grid = sum(k[o] * side[o : o + len(grid)] for o in range(len(k))).T
    return grid / grid.max()


@pytest.mark.parametrize("grid", [(20, 12), (3, 2), (1, 30), (120, 90)])  # narrower than the kernel, too
def test_density(spark, grid):
    rng = np.random.default_rng(5)
    points = [(float(x), float(y), int(n)) for x, y, n in zip(rng.random(60), rng.random(60), rng.integers(0, 4, 60))] + [(0.0, 0.0, 40), (1.0, 1.0, 2), (0.5, 0.5, 0)]
    df = spark.createDataFrame(points, "x double, y double, n int")
    got = tr.density(df, "x", "y", "n", grid).collect()
    want = plain_density(points, *grid)
    assert {(r.i, r.j) for r in got} == {tuple(map(int, c)) for c in np.argwhere(want > 0)} and len(got) == (want > 0).sum()
    assert all(abs(r.height - want[r.i, r.j]) < 1e-8 and r.level == int(r.height**0.42 * 255) for r in got)
    assert tr.density(df.limit(0), "x", "y", "n", grid).collect() == []


def test_place(spark):
    rows = [(2.0, 7.0), (4.0, 7.0), (3.0, 7.0), (None, 1.0), (1.0, float("nan")), (float("inf"), 2.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert sorted(map(tuple, tr.place(df, "x", "y").collect())) == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]
    assert tr.place(df.limit(0), "x", "y").collect() == []


@pytest.mark.parametrize("text", [False, True])
def test_territories_and_frontiers(spark, text):
    """Points on the nodes' middles tie; some places are taken twice, so the least key decides."""
    rng = np.random.default_rng(11)
    w, h = 9, 5
    at = [(int(a) / 16, int(b) / 8) for a, b in zip(rng.integers(0, 17, 700), rng.integers(0, 9, 700))]
    points = [(f"k{i}" if text else i, x, y, f"z{i % 3}") for i, (x, y) in zip(rng.permutation(700).tolist(), at)]
    none = [(None, 0.0, 0.0, "n"), (points[0][0], None, 0.0, "n"), (points[0][0], 0.0, 0.0, None)]
    df = spark.createDataFrame(points + none, f"key {'string' if text else 'bigint'}, x double, y double, zone string").repartition(3)
    nodes = tr.territories(df, "key", "x", "y", "zone", (w, h))
    got = {(r.i, r.j): (r.key, r.zone) for r in nodes.collect()}
    near = lambda i, j: min(((x - i / (w - 1)) ** 2 + (y - j / (h - 1)) ** 2, k, z) for k, x, y, z in points)[1:]
    assert got == {(i, j): near(i, j) for i in range(w) for j in range(h)}
    want = [(i, j, i + 1, j) for i in range(w - 1) for j in range(h) if got[i, j][1] != got[i + 1, j][1]]
    want += [(i, j, i, j + 1) for i in range(w) for j in range(h - 1) if got[i, j][1] != got[i, j + 1][1]]
    lines = tr.frontiers(nodes, "zone", (w, h)).collect()
    middles = sorted((round((r.x1 + r.x2) / 2 * (w - 1), 2), round((r.y1 + r.y2) / 2 * (h - 1), 2)) for r in lines)
    inner = [(a, b, c, d) for a, b, c, d in want if (a == c or 0 < b < h - 1) and (b == d or 0 < a < w - 1)]
    assert len(lines) == len(want) and all(any(abs((a + c) / 2 - x) < 0.01 and abs((b + d) / 2 - y) < 0.01 for x, y in middles) for a, b, c, d in inner)
    assert tr.territories(df.limit(0), "key", "x", "y", "zone", (w, h)).collect() == []
    with pytest.raises(ValueError, match="grid"):
        tr.territories(df, "key", "x", "y", "zone", (1, 5))
