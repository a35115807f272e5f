"""The driver's tables as the engine's own: files, edges, modules, identifiers, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: path, language, module (its source), size."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("/", "source", F.concat("lang", F.lit("_"), F.col("doc_id").cast("string"))).alias("path"),
        F.col("lang").alias("language"),
        F.col("source").alias("module"),
        F.col("n_chars").alias("size"),
        "doc_id",
    )


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports between parts: from each line of an order to the next one; w is the line's quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    pairs = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_quantity").alias("w"))
    return pairs.where("dst IS NOT NULL AND src <> dst")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All imports, each once, whatever their weight."""
    return all_edges(spark, sf_dir).select("src", "dst").distinct()


#: Orders of a folder, and links between orders: (condition, target), in SQL that Spark and DuckDB share. Most lead on
#: within the folder, each tenth customer's back, and some to the folder after.
FOLDER = 20
_LINKS = [
    ("true", "k + 1 + c % 5", True),
    ("true", "k + 2 + c % 7", True),
    ("c % 10 = 0", "k - 1 - c % 3", True),
    ("c % 61 = 0", f"(floor(k / {FOLDER}) + 1) * {FOLDER} + c % {FOLDER}", False),
]
_LINKED = " UNION ALL ".join(
    f"SELECT k AS src, CAST({to} AS BIGINT) AS dst FROM ordered WHERE {given}" + (f" AND floor(({to}) / {FOLDER}) = floor(k / {FOLDER})" if inside else "")
    for given, to, inside in _LINKS
)
ORDER_EDGES_SQL = f"""
ordered AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
edges AS (SELECT DISTINCT src, dst FROM ({_LINKED}) WHERE dst IN (SELECT k FROM ordered) AND src <> dst)"""


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports between orders as files: folders of FOLDER orders with rings in some of them, in several layers."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c")
    parts = []
    for given, to, inside in _LINKS:
        rows = o.where(given).selectExpr("k AS src", f"CAST({to} AS BIGINT) AS dst")
        same = F.expr(f"floor(dst / {FOLDER}) = floor(src / {FOLDER})")
        parts.append(rows.where(same) if inside else rows)
    met = reduce(DataFrame.unionAll, parts).where("src <> dst").distinct()
    return met.join(o.select(F.col("k").alias("dst")), "dst", "left_semi").select("src", "dst")


ALL_EDGES_SQL = """
all_edges AS (SELECT * FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS dst,
         l_quantity AS w FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""
EDGES_SQL = f"""{ALL_EDGES_SQL},
edges AS (SELECT DISTINCT src, dst FROM all_edges)"""
