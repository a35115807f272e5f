"""Queries of maps: points, density, territories and their borders, over vectors; roll-ups over paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import terrain as tr
from graphloom.plans.registry import query
from graphloom.plans.tables import table

GRID, NODES, CAP = (96, 64), (60, 40), 200


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by their first two components, each with a weight and a zone."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return tr.place(e.withColumn("weight", 1 + F.col("vec_id") % 3), "x", "y")


_POINTS = """
e AS (SELECT vec_id, label, 1 + vec_id % 3 AS weight, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
ends AS (SELECT min(x) AS x0, max(x) - min(x) AS xs, min(y) AS y0, max(y) - min(y) AS ys FROM e),
points AS MATERIALIZED (SELECT vec_id, label, weight, (x - x0) / xs AS x, (y - y0) / ys AS y FROM e, ends)"""


def _blur(source: str, axis: str, other: str, n: int, weights: list[float]) -> str:
    r = len(weights) // 2
    rows = ", ".join(f"({o - r}, {w!r}::DOUBLE)" for o, w in enumerate(weights))
    at = f"((({axis} + o) % {2 * n} + {2 * n}) % {2 * n})"
    return f"""(SELECT {other}, CASE WHEN {at} < {n} THEN {at} ELSE {2 * n - 1} - {at} END AS {axis}, sum(v * k) AS v
      FROM {source}, (VALUES {rows}) AS kernel(o, k) GROUP BY 1, 2)"""


def _density_sql(w: int, h: int) -> str:
    weights = tr.kernel(max(1.5, min(w, h) / 50))
    cell = lambda c, n: f"greatest(0, least({n - 1}, CAST(floor({c} * {n - 1}) AS INT)))"
    return f"""WITH {_POINTS},
    filled AS (SELECT {cell("x", w)} AS i, {cell("y", h)} AS j, sum(weight)::DOUBLE AS v FROM points GROUP BY 1, 2),
    across AS {_blur("filled", "i", "j", w, weights)}, down AS {_blur("across", "j", "i", h, weights)},
    high AS (SELECT i, j, round(v / (SELECT max(v) FROM down), 9) AS height FROM down)
    SELECT i, j, height, CAST(floor(pow(height, 0.42) * 255) AS INT) AS level FROM high"""


@query("terrain_density", _density_sql(*GRID))
def terrain_density(spark: SparkSession, d: str) -> DataFrame:
    """Heights of a terrain over all vectors."""
    return tr.density(_points(spark, d), "x", "y", "weight", GRID)


_NODES_SQL = f"""
nodes AS MATERIALIZED (SELECT i, j, arg_min(label, (away, vec_id)) AS label, arg_min(vec_id, (away, vec_id)) AS vec_id FROM (
  SELECT i, j, label, vec_id, (x - i / {NODES[0] - 1}) * (x - i / {NODES[0] - 1}) + (y - j / {NODES[1] - 1}) * (y - j / {NODES[1] - 1}) AS away
  FROM points, range({NODES[0]}) AS a(i), range({NODES[1]}) AS b(j)) GROUP BY 1, 2)"""


@query("terrain_territories", f"WITH {_POINTS}, {_NODES_SQL} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, vec_id, label FROM nodes")
def terrain_territories(spark: SparkSession, d: str) -> DataFrame:
    """The vector nearest to each node of a grid, and its label."""
    return tr.territories(_points(spark, d), "vec_id", "x", "y", "label", NODES)


def _on(c: str, n: int) -> str:
    return f"round(least({n - 1}.0::DOUBLE, greatest(0.0::DOUBLE, {c}::DOUBLE)) / {n - 1}, 4)"


_X, _Y = NODES
_BORDERS = f"""
SELECT {_on("(a.i + 0.5)", _X)} AS x1, {_on("(a.j - 0.5)", _Y)} AS y1, {_on("(a.i + 0.5)", _X)} AS x2, {_on("(a.j + 0.5)", _Y)} AS y2
  FROM nodes a JOIN nodes b ON b.i = a.i + 1 AND b.j = a.j WHERE a.label <> b.label
UNION ALL SELECT {_on("(a.i - 0.5)", _X)}, {_on("(a.j + 0.5)", _Y)}, {_on("(a.i + 0.5)", _X)}, {_on("(a.j + 0.5)", _Y)}
  FROM nodes a JOIN nodes b ON b.j = a.j + 1 AND b.i = a.i WHERE a.label <> b.label"""


@query("terrain_frontiers", f"WITH {_POINTS}, {_NODES_SQL} {_BORDERS}")
def terrain_frontiers(spark: SparkSession, d: str) -> DataFrame:
    """Borders between the territories of labels."""
    return tr.frontiers(tr.territories(_points(spark, d), "vec_id", "x", "y", "label", NODES), "label", NODES)


@query("terrain_projection")
def terrain_projection(spark: SparkSession, d: str) -> DataFrame:
    """All vectors along their two principal components, moved to 0 to 1."""
    found = tr.project(table(spark, d, "embeddings"), "vec_id", "embedding")
    at = tr.place(found.select("vec_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")), "x", "y")
    return at.withColumns({c: F.round(c, 6) for c in ("x", "y")})


def _rolled_sql(cap: int) -> str:
    depths = range(8, 1, -1)
    group = lambda n: f"array_to_string(string_split(path, '/')[1:least({n}, len(string_split(path, '/')) - 1)], '/')"
    case = " ".join(f"WHEN count(DISTINCT {group(n)}) <= {cap} THEN {n}" for n in depths)
    cut = " ".join(f"WHEN {n} THEN {group(n)}" for n in [*depths, 1])
    return f"""WITH f AS (SELECT lower(replace(p_type, ' ', '/') || '/' || replace(p_name, ' ', '/')) AS path FROM part),
    s AS (SELECT CASE {case} ELSE 1 END AS segments FROM f)
    SELECT segments, "group", count(*) AS files FROM (SELECT segments, CASE segments {cut} END AS "group" FROM f, s) GROUP BY 1, 2"""


@query("terrain_rollup", _rolled_sql(CAP))
def terrain_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Folders rolled up as little as keeps their groups few, and the files of each group."""
    path = F.lower(F.concat_ws("/", F.replace("p_type", F.lit(" "), F.lit("/")), F.replace("p_name", F.lit(" "), F.lit("/"))))
    files = table(spark, d, "part").select(path.alias("path"))
    n = tr.auto_segments(files, "path", CAP)
    rolled = files.groupBy(tr.group_of(F.col("path"), n).alias("group")).agg(F.count("*").alias("files"))
    return rolled.select(F.lit(n).alias("segments"), "group", "files")
