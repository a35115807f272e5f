"""Queries of what is added to files: roles, what is summarised, other labels of concepts, extensions of bundles, caveats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import classify as cl
from graphloom.functions import text as tx
from graphloom.operators import constraints as cs
from graphloom.operators.scratch import checkpoint_dir
from graphloom.plans.bundles import X, part_triples
from graphloom.plans.codebase import sql_rows
from graphloom.plans.graphs import _CANON, _TOKENS
from graphloom.plans.registry import query
from graphloom.plans.tables import table
from graphloom.sources import artifacts as ar
from graphloom.sources import bundle as b
from graphloom.sources import extensions as ex
from graphloom.sources import gate

#: (path before the number, path after it, type, language, phases, roles, summarised, schema) of a file for each part.
FILES = [
    ("src/m", ".py", "source_code", "python", [], "production", True, False), ("Tests/m", ".py", "source_code", "python", ["runtime"], "production,test", True, False),
    ("lib/m", "_spec.rb", "test_code", "ruby", ["test"], "test", False, False), ("lib/test_", ".go", "source_code", "go", ["ci"], "production,quality_gate,test", True, False),
    (".github/workflows/m", ".yml", "configuration", "yaml", [], "configuration,quality_gate", False, False), ("m", ".lock", "lockfile", None, ["test"], "dependency,test", False, False),
    ("m", "", "unknown", None, [], "unknown", False, False), ("static/schemas/m", ".XSD", "source_code", "json", [], "production", False, True),
    ("static/schemas/m", ".txt", "documentation", "text", [], "documentation", False, False), ("x/static/schemas/m", ".xml", "asset", None, [], "asset", False, False),
    ("static/schemas/a/m", ".proto", "ci_cd", None, [], "quality_gate", False, True), ("contest/m", "test.css", "source_code", "css", [], "production", True, False),
]


@query(
    "file_roles",
    f"""WITH k(i, before, after, roles, summarised, schema) AS (VALUES {sql_rows([(i, f[0], f[1], f[5], f[6], f[7]) for i, f in enumerate(FILES)])})
    SELECT before || p_partkey || after AS path, roles, summarised, schema FROM part JOIN k ON i = p_size % {len(FILES)}""",
)
def file_roles(spark: SparkSession, d: str) -> DataFrame:
    """All roles of each file, whether it is summarised, and whether it is a schema."""
    kinds = spark.createDataFrame([(i, *f[:5]) for i, f in enumerate(FILES)], "i int, before string, after string, type string, language string, phases array<string>")
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_size") % len(FILES)).alias("i"))
    f = parts.join(F.broadcast(kinds), "i").withColumn("path", F.concat("before", F.col("p_partkey").cast("string"), "after"))
    roles = F.array_join(cl.roles(F.col("path"), F.col("type"), F.col("phases")), ",")
    return f.select("path", roles.alias("roles"), cl.summarised(F.col("type"), F.col("language")).alias("summarised"), cl.schema_file(F.col("path")).alias("schema"))


@query(
    "concept_alternates",
    f"""WITH ident AS (SELECT p_partkey AS id, replace(p_name || ' ' || p_type, ' ', '_') AS s FROM part UNION ALL SELECT -1 - p_partkey, replace(p_name, ' ', 'Files_') FROM part),
    toks AS (SELECT id, s, unnest({_TOKENS}) AS t, generate_subscripts({_TOKENS}, 1) AS place FROM ident),
    c AS (SELECT id, s, t, place, {_CANON} AS concept FROM toks)
    SELECT id, concept, CASE WHEN len(any_value(s)) <= 30 THEN any_value(s) ELSE arg_min(t, place) END AS alternate FROM c WHERE concept IS NOT NULL GROUP BY 1, 2""",
)
def concept_alternates(spark: SparkSession, d: str) -> DataFrame:
    """each identifier's concepts with the form that shows them."""
    part = table(spark, d, "part")
    whole = part.select(F.col("p_partkey").alias("id"), F.replace(F.concat_ws(" ", "p_name", "p_type"), F.lit(" "), F.lit("_")).alias("s"))
    ident = whole.unionAll(part.select(-1 - F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("Files_"))))
    each = ident.select("id", "s", F.explode(F.array_distinct(tx.concepts_of(F.col("s")))).alias("concept"))
    return each.select("id", "concept", tx.alternate(F.col("concept"), F.col("s")).alias("alternate"))


def _by_brand(files: DataFrame, made: ex.Tables) -> DataFrame:
    return files.groupBy("brand").agg(F.count("*").alias("n"), F.max("large").alias("large"))


def _fails(files: DataFrame, made: ex.Tables) -> DataFrame:
    return files.select(F.raise_error(F.lit("no model")).alias("x"))


def _extensions() -> ex.Extensions:
    known = ex.Extensions().aggregator("l2_brands", _by_brand).aggregator("l4_model", _fails, optional=True)
    known.enricher("l2_size", large=F.col("size") > 25).enricher("l1_label", label=F.concat_ws(" ", "brand", F.col("size").cast("string")))
    known.enricher("l3_long", title=F.when(F.col("large"), F.upper("label")).otherwise(F.col("label")))
    known.contributor("titles", lambda files, made: ex.literals(files, F.concat(F.lit(f"{X}part/"), F.col("id").cast("string")), f"{X}title", F.col("title")))
    known.contributor("brands", lambda files, made: ex.literals(made["l2_brands"], F.concat(F.lit(f"{X}brand/"), F.replace("brand", F.lit("#"), F.lit("-"))), f"{X}count", F.col("n")))
    known.shape("titled", [cs.Shape("Titled", "files", "id", [cs.Property("title", {"pattern": "^BRAND"})])])
    return known.emitter("brands", lambda files, made: {"brands": made["l2_brands"]})


@query(
    "extended_bundle",
    f"""WITH f AS (SELECT p_partkey, p_size > 25 AS large, p_brand, CASE WHEN p_size > 25 THEN upper(p_brand || ' ' || p_size) ELSE p_brand || ' ' || p_size END AS title FROM part)
    SELECT '{X}part/' || p_partkey AS name, 'title' AS what, title AS value FROM f
    UNION ALL SELECT '{X}brand/' || replace(p_brand, '#', '-'), 'count', CAST(count(*) AS VARCHAR) FROM f GROUP BY p_brand
    UNION ALL SELECT p_brand, 'large', CAST(bool_or(large) AS VARCHAR) FROM f GROUP BY p_brand
    UNION ALL SELECT 'l4_model', 'degradation', 'false' UNION ALL SELECT 'Titled', 'conforms', CAST(count(*) FILTER (title NOT LIKE 'BRAND%') = 0 AS VARCHAR) FROM f""",
)
def extended_bundle(spark: SparkSession, d: str) -> DataFrame:
    """A bundle with what extensions of each kind add; one of them fails and is disclosed."""
    place = f"{checkpoint_dir(spark)}/extended-{uuid.uuid4().hex}"
    known = _extensions()
    files = table(spark, d, "part").selectExpr("p_partkey AS id", "p_brand AS brand", "p_size AS size")
    known.emit(files, part_triples(spark, d), place)
    added = b.read_ntriples(spark, f"{place}/graph.nt").where(F.col("p").isin(f"{X}title", f"{X}count"))
    brands = ar.load(spark, place)["brands"].select("brand", F.lit("large"), F.col("large").cast("string"))
    checks = gate.check(spark, place, {}, shapes=known.all_shapes()).where(F.col("check").isin("degradation", "conforms"))
    out = added.select(F.col("s").alias("name"), F.substring_index("p", "/", -1).alias("what"), F.col("o").alias("value"))
    return out.unionAll(brands).unionAll(checks.select("name", "check", F.col("ok").cast("string")))
