"""Maps of what is alike: vectors projected to a plane, density over a grid, borders between territories.

Grids have a stated number of cells, so whatever is kept for each cell is bounded; points may be any number. Points are never
shuffled: they are added up, or reduced to a candidate for each cell, where they are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.vectors import dot, doubles

#: Cells of a grid and components of a vector, at most; what is kept for each of them is held by a task or the driver.
MOST_CELLS = 1 << 20
MOST_COMPONENTS = 2048
#: Points whose distances to all cells are taken at once.
BLOCK = 256


def group_of(path: Column, segments: int) -> Column:
    """The first `segments` folders of a file's path; `.` for a file outside of any folder."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.when(F.size(folders) > 0, F.array_join(F.slice(folders, 1, segments), "/")).when(path.isNotNull(), F.lit("."))


def auto_segments(files: DataFrame, path: str, cap: int, deepest: int = 8) -> int:
    """The greatest number of folders, from `deepest` down to 2, that gives at most `cap` groups; 1 if none does.

    One pass for all depths. Null paths are in no group.
    """
    depths = range(deepest, 1, -1)
    counts = files.agg(*[F.count_distinct(group_of(F.col(path), d)).alias(f"d{d}") for d in depths]).first()
    return next((d for d in depths if counts[f"d{d}"] <= cap), 1)


def project(df: DataFrame, key: str, vector: str, axes: int = 2) -> DataFrame:
    """(key, p array<double>): the vectors along their `axes` principal components, about their mean.

    Products of components are added up where the vectors are read; the driver holds one square matrix of a vector's width. A
    component's sign is that which makes its greatest entry positive. Vectors that are null, of another width than most (the
    lesser of equals) or have a null, NaN or infinite component are left out; with fewer components than axes, the rest are 0.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.select(key, doubles(F.col(vector)).alias("v")).where(F.col("v").isNotNull() & finite)
    widths = kept.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"))
    most = widths.where("w > 0").orderBy(F.desc("n"), "w").first()
    if most is None:
        return kept.limit(0).select(key, F.col("v").alias("p"))
    width = most["w"]
    if width > MOST_COMPONENTS:
        raise ValueError(f"vectors of {width} components; at most {MOST_COMPONENTS}")
    kept = kept.where(F.size("v") == width)
    mean = np.array(kept.agg(*[F.avg(F.col("v")[i]) for i in range(width)]).first(), dtype=float)

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy()) - mean
                total += x.T @ x
        yield pd.DataFrame({"i": range(width), "row": list(total)})

    sums = kept.select("v").mapInPandas(products, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    gram = np.zeros((width, width))
    for r in sums.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # width * width numbers
        gram[r["i"], r["j"]] = r["x"]
    found = np.linalg.eigh(gram)[1][:, ::-1].T[:axes]
    found = [a if a[np.argmax(np.abs(a))] > 0 else -a for a in found]
    away = F.zip_with("v", F.array(*[F.lit(float(x)) for x in mean]), lambda x, y: x - y)
    along = [dot(F.col("c"), F.array(*[F.lit(float(x)) for x in a])) for a in found] + [F.lit(0.0)] * (axes - len(found))
    return kept.select(key, away.alias("c")).select(key, F.array(*along).alias("p"))


def place(points: DataFrame, x: str, y: str) -> DataFrame:
    """The points with x and y moved to 0 to 1 on each axis, 0 where all are equal. Rows without a finite x and y are left out."""
    real = [F.col(c).cast("double").isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in (x, y)]
    kept = points.where(real[0] & real[1]).withColumns({c: F.col(c).cast("double") for c in (x, y)})
    ends = kept.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate((x, y)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for i, c in enumerate((x, y)):
        lo, hi = ends[f"lo{i}"] or 0.0, ends[f"hi{i}"] or 0.0
        out[c] = (F.col(c) - lo) / F.lit(hi - lo) if hi > lo else F.lit(0.0)
    return kept.withColumns(out)


def kernel(sigma: float) -> list[float]:
    """Weights of a Gaussian from -r to r, r four sigma rounded; they add up to 1."""
    r = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * o * o / (sigma * sigma)) for o in range(-r, r + 1)]
    return [w / sum(raw) for w in raw]


def density(points: DataFrame, x: str, y: str, weight: str, grid: tuple[int, int], sigma: float | None = None) -> DataFrame:
    """(i, j, height, level) of a grid's cells above 0: the points' weights, blurred; height is a share of the peak's.

    x and y lie in 0 to 1 (see `place`). What the blur would carry over an edge is mirrored there. A level is 0 to 255, the height
    to the power of 0.42. Points are added up in cells first, so that each of the two passes of the blur reads cells alone.
    """
    w, h = grid
    if not (w > 0 and h > 0 and w * h <= MOST_CELLS):
        raise ValueError(f"a grid has 1 to {MOST_CELLS} cells")
    weights = kernel(sigma or max(1.5, min(w, h) / 50))
    r = len(weights) // 2

    def cell(c: str, n: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.col(c) * (n - 1)))).cast("int")

    def blurred(cells: DataFrame, axis: str, n: int) -> DataFrame:
        spread = F.explode(F.transform(F.array(*map(F.lit, weights)), lambda k, o: F.struct((F.col(axis) + o - r).alias("t"), (F.col("v") * k).alias("v"))))
        other = "j" if axis == "i" else "i"
        at = F.pmod("s.t", F.lit(2 * n))  # mirrored at both edges, as often as it takes
        to = F.when(at < n, at).otherwise(2 * n - 1 - at)
        return cells.select(other, spread.alias("s")).groupBy(other, to.alias(axis)).agg(F.sum("s.v").alias("v"))

    filled = points.groupBy(cell(x, w).alias("i"), cell(y, h).alias("j")).agg(F.sum(F.col(weight).cast("double")).alias("v")).where("v > 0")
    smooth = blurred(blurred(filled, "i", w), "j", h)
    peak = smooth.agg(F.max("v").alias("peak"))  # one row
    height = F.round(F.col("v") / F.col("peak"), 9)
    level = F.floor(F.pow(height, F.lit(0.42)) * 255).cast("int")
    return smooth.join(F.broadcast(peak), F.lit(True)).select("i", "j", height.alias("height"), level.alias("level"))


def territories(points: DataFrame, key: str, x: str, y: str, zone: str, grid: tuple[int, int]) -> DataFrame:
    """(i, j, key, zone): for each node of a grid over 0 to 1 the nearest point, the least key of equally near ones, and its zone.

    A task keeps a candidate for each node and sends those alone, however many points it reads. Keys are integers or strings.
    Points without a key, a zone, or a place are left out; without points there is no row.
    """
    w, h = grid
    if not (w > 1 and h > 1 and w * h <= MOST_CELLS // 16):
        raise ValueError(f"a grid has at least two nodes a side, at most {MOST_CELLS // 16} in all")
    key_type, zone_type = points.schema[key].dataType.simpleString(), points.schema[zone].dataType.simpleString()
    if key_type not in ("tinyint", "smallint", "int", "bigint", "string"):
        raise ValueError(f"{key}: keys are integers or strings")
    kept = points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(zone).alias("zone"))
    kept = kept.dropna().where(~F.isnan("x") & ~F.isnan("y"))

    def candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i, j = np.tile(np.arange(w), h), np.repeat(np.arange(h), w)
        cx, cy = i / (w - 1), j / (h - 1)
        away = np.full(w * h, np.inf)
        keys, zones = np.full(w * h, None, dtype=object), np.full(w * h, None, dtype=object)
        for f in frames:
            f = f.sort_values("key")
            for a in range(0, len(f), BLOCK):
                part = f.iloc[a : a + BLOCK]
                dx, dy = part["x"].to_numpy()[:, None] - cx, part["y"].to_numpy()[:, None] - cy
                d = dx * dx + dy * dy
                first = d.argmin(axis=0)  # the least key of equals, as they are sorted
                least, k = d[first, np.arange(w * h)], part["key"].to_numpy(dtype=object)[first]
                tie = np.flatnonzero((least == away) & (least < np.inf))
                better = least < away
                better[tie] = [k[t] < keys[t] for t in tie]
                away[better], keys[better], zones[better] = least[better], k[better], part["zone"].to_numpy(dtype=object)[first][better]
        if np.isfinite(away).all():
            yield pd.DataFrame({"i": i, "j": j, "away": away, "key": keys, "zone": zones})

    found = kept.mapInPandas(candidates, f"i int, j int, away double, key {key_type}, zone {zone_type}")
    best = found.groupBy("i", "j").agg(F.min(F.struct("away", "key", "zone")).alias("b"))
    return best.select("i", "j", F.col("b.key").alias(key), F.col("b.zone").alias(zone))


def frontiers(nodes: DataFrame, zone: str, grid: tuple[int, int]) -> DataFrame:
    """(x1, y1, x2, y2) of the borders between neighbouring nodes of unlike zones, halfway between them, to four digits."""
    w, h = grid

    def on(c: Column, n: int) -> Column:
        return F.round(F.least(F.lit(float(n - 1)), F.greatest(F.lit(0.0), c)) / (n - 1), 4)

    right = F.lead(zone).over(Window.partitionBy("j").orderBy("i")).alias("right")  # a row of the grid
    below = F.lead(zone).over(Window.partitionBy("i").orderBy("j")).alias("below")
    i, j = F.col("i"), F.col("j")
    upright = nodes.select("i", "j", zone, right).where(F.col("right") != F.col(zone))
    level = nodes.select("i", "j", zone, below).where(F.col("below") != F.col(zone))
    lines = upright.select(on(i + 0.5, w).alias("x1"), on(j - 0.5, h).alias("y1"), on(i + 0.5, w).alias("x2"), on(j + 0.5, h).alias("y2"))
    return lines.unionAll(level.select(on(i - 0.5, w), on(j + 0.5, h), on(i + 0.5, w), on(j + 0.5, h)))
