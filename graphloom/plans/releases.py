"""Queries of the checks that a bundle passes before it is released."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import constraints as cs
from graphloom.operators.scratch import checkpoint_dir
from graphloom.plans.bundles import X, part_triples
from graphloom.plans.registry import query
from graphloom.plans.tables import table
from graphloom.sources import artifacts as ar
from graphloom.sources import gate

#: Columns of a file that is a part, in SQL that Spark and DuckDB share.
_FILE = """p_partkey AS id, p_size AS size, CASE WHEN p_size % 40 <> 3 THEN 'python' END AS language, p_size % 3 <> 0 AS is_source,
  CASE WHEN p_size % 29 = 0 THEN 1 ELSE 0 END AS n_errors, CASE WHEN p_size % 31 = 5 THEN 0 ELSE 2 END AS n_symbols, p_size % 4 AS n_imports"""
#: Files that are added to the changed bundle when its manifest is written already.
_ADDED = _FILE.replace("CASE WHEN p_size % 40 <> 3 THEN 'python' END", "CASE WHEN false THEN '' END")
SHAPES = [cs.Shape("File", "files", "id", [cs.Property("size", {"min_inclusive": 3}), cs.Property("language", {"min_count": 1})])]


def _emitted(spark: SparkSession, d: str, graph: str, meta: dict[str, object]) -> str:
    part = table(spark, d, "part")
    place = f"{checkpoint_dir(spark)}/release-{uuid.uuid4().hex}"
    tables = {
        "files": part.selectExpr(*(c.strip() for c in _FILE.replace("\n", " ").split(", "))),
        "imports": part.where("p_size % 3 > 0").select(F.col("p_partkey").alias("src"), F.explode(F.sequence(F.lit(1), F.col("p_size") % 3)).alias("dst")),
    }
    ar.emit(tables, part_triples(spark, d).where(graph), place, {"counts": {"files": part.count()}, **meta})
    return place


_GATE_SQL = f"""WITH f AS (SELECT 'whole' AS state, {_FILE} FROM part UNION ALL SELECT 'changed', {_FILE} FROM part
  UNION ALL SELECT 'changed', {_ADDED} FROM part WHERE p_size % 10 = 0),
m AS (SELECT state, count(*) AS n, count(*) FILTER (is_source) AS src, count(*) FILTER (is_source AND n_errors > 0) AS bad, count(*) FILTER (language IS NULL) AS mute,
  count(*) FILTER (is_source AND n_errors = 0 AND n_symbols = 0) AS silent, sum(n_imports) AS extracted, count(*) FILTER (size < 3) + count(*) FILTER (language IS NULL) AS unfit
  FROM f GROUP BY 1),
e AS (SELECT sum(p_size % 3) AS edges, count(*) AS parts, count(*) FILTER (p_partkey % 10 <> 7) AS kept FROM part),
r AS (
  SELECT state, 'manifest' AS "check", 'manifest' AS name, NULL AS found, NULL AS bound, true AS ok FROM m
  UNION ALL SELECT 'none', 'manifest', 'manifest', NULL, NULL, false
  UNION ALL SELECT state, 'digest', 'files', n, parts, n = parts FROM m, e
  UNION ALL SELECT state, 'digest', 'imports', edges, edges, true FROM m, e
  UNION ALL SELECT state, 'digest', 'triples', 4 * CASE state WHEN 'whole' THEN parts ELSE kept END, 4 * CASE state WHEN 'whole' THEN parts ELSE kept END, true FROM m, e
  UNION ALL SELECT state, 'recount', 'files', CASE state WHEN 'whole' THEN parts ELSE kept END, parts, state = 'whole' OR parts = kept FROM m, e
  UNION ALL SELECT state, 'conforms', 'File', unfit, 0, unfit = 0 FROM m
  UNION ALL SELECT 'whole', 'degradation', 'chunks', NULL, NULL, true UNION ALL SELECT 'whole', 'degradation', 'vectors', NULL, NULL, false
  UNION ALL SELECT 'changed', 'degradation', 'undisclosed', NULL, NULL, false
  UNION ALL SELECT state, 'budget', 'parse_errors', bad / src, 0.05, bad / src <= 0.05 FROM m
  UNION ALL SELECT state, 'budget', 'unlanguaged', mute / n, 0.03, mute / n <= 0.03 FROM m
  UNION ALL SELECT state, 'budget', 'silent', silent, 0, silent = 0 FROM m
  UNION ALL SELECT state, 'budget', 'resolved', edges / extracted, 0.5, edges / extracted >= 0.5 FROM m, e)
SELECT state, "check", name, round(CAST(found AS DOUBLE), 9) AS found, CAST(bound AS DOUBLE) AS bound, ok FROM r"""


@query("release_checks", _GATE_SQL)
def release_checks(spark: SparkSession, d: str) -> DataFrame:
    """Q03: the checks of a whole bundle, of one changed since, whose graph lacks files, and of none."""
    whole = _emitted(spark, d, "true", {"degradations": {"chunks": "no grammar", "vectors": "no model"}})
    changed = _emitted(spark, d, "s NOT LIKE '%7'", {})
    added = table(spark, d, "part").where("p_size % 10 = 0").selectExpr(*(c.strip() for c in _ADDED.replace("\n", " ").split(", ")))
    added.write.mode("append").parquet(f"{changed}/files")
    states = {"whole": whole, "changed": changed, "none": f"{changed}/none"}
    found = [gate.check(spark, p, {"files": f"{X}Part"}, accepted={"chunks"}, shapes=SHAPES).withColumn("state", F.lit(s)) for s, p in states.items()]
    return reduce(DataFrame.unionAll, found).withColumn("found", F.round("found", 9))
