"""Queries that write bundles to shared storage, read them back and ask them: triples, JSON-LD, JSON lines, blobs, SPARQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import decompose as dc
from graphloom.operators.scratch import checkpoint_dir
from graphloom.plans.registry import query
from graphloom.plans.tables import table
from graphloom.sources import artifacts as ar
from graphloom.sources import bundle as b
from graphloom.sources import gate
from graphloom.sources import rebuild as rb
from graphloom.sources import sparql

X, A = "http://x/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
INTEGER = "http://www.w3.org/2001/XMLSchema#integer"


def _place(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/bundle-{uuid.uuid4().hex}"


def _iri(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{X}{kind}/"), F.col(key).cast("string"))


def part_triples(spark: SparkSession, d: str) -> DataFrame:
    """Parts, their brands and their supplier links as triples; names hold characters that must be escaped."""
    part = table(spark, d, "part")
    null = F.lit(None).cast("string")

    def rows(p: str, o: Column, kind: str, datatype: Column = null, lang: Column = null) -> DataFrame:
        return part.select(
            _iri("part", "p_partkey").alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), datatype.alias("datatype"), lang.alias("lang")
        )

    name = F.concat(F.lit('"'), "p_name", F.lit('"\\ \n\t'), F.lit("é😀"))
    out = rows(A, F.lit(f"{X}Part"), "iri")
    out = out.unionAll(rows(f"{X}brand", F.concat(F.lit(f"{X}brand/"), F.replace("p_brand", F.lit("#"), F.lit("-"))), "iri"))
    out = out.unionAll(rows(f"{X}name", name, "literal", lang=F.lit("en")))
    return out.unionAll(rows(f"{X}size", F.col("p_size").cast("string"), "literal", datatype=F.lit(INTEGER)))


_TRIPLES = f"""
t AS (SELECT '{X}part/' || p_partkey AS s, '{A}' AS p, '{X}Part' AS o, 'iri' AS o_kind, NULL AS datatype, NULL AS lang FROM part
  UNION ALL SELECT '{X}part/' || p_partkey, '{X}brand', '{X}brand/' || replace(p_brand, '#', '-'), 'iri', NULL, NULL FROM part
  UNION ALL SELECT '{X}part/' || p_partkey, '{X}name', '"' || p_name || '"\\ ' || chr(10) || chr(9) || 'é😀', 'literal', NULL, 'en' FROM part
  UNION ALL SELECT '{X}part/' || p_partkey, '{X}size', CAST(p_size AS VARCHAR), 'literal', '{INTEGER}', NULL FROM part)"""


@query("ntriples_roundtrip", f"WITH {_TRIPLES} SELECT * FROM t")
def ntriples_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Triples written in order as N-Triples and read again. S14, K02, O08, F07."""
    place = _place(spark)
    b.ntriples(part_triples(spark, d)).write.text(place)
    return b.read_ntriples(spark, place)


@query(
    "literal_escapes",
    """SELECT p_partkey, 'a' || chr(9) || chr(8) || chr(10) || chr(13) || chr(12) || '"' || chr(39) || chr(92) || 'é😀😀' || chr(92) || 'q' || p_partkey AS text FROM part""",
)
def literal_escapes(spark: SparkSession, d: str) -> DataFrame:
    """Every escape of a literal, surrogate pairs too; what is no escape stays. F07."""
    raw = F.concat(F.lit(r"a\t\b\n\r\f\"\'\\é😀\U0001F600\q"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", b.unescape(raw).alias("text"))


_NODES = f"""
n AS (SELECT '{X}part/' || p_partkey AS id, CASE WHEN p_size > 25 THEN 'Part,Large' ELSE 'Part' END AS types, p_name AS name, CAST(p_size AS BIGINT) AS size FROM part)"""


def part_nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, node) of parts as JSON-LD, of one type or of two."""
    one, two = F.to_json(F.struct(F.lit("Part").alias("t"))), F.to_json(F.struct(F.array(F.lit("Part"), F.lit("Large")).alias("t")))
    kind = F.regexp_extract(F.when(F.col("p_size") > 25, two).otherwise(one), r"^\{\"t\":(.*)\}$", 1)
    text = F.to_json(F.struct(_iri("part", "p_partkey").alias("@id"), F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("size")))
    node = F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(',"@type":'), kind, F.lit("}"))
    return table(spark, d, "part").select(_iri("part", "p_partkey").alias("id"), node.alias("node"))


def _routed(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "id",
        F.array_join("types", ",").alias("types"),
        F.try_variant_get("node", "$.name", "string").alias("name"),
        F.try_variant_get("node", "$.size", "bigint").alias("size"),
    )


@query("jsonld_scan", f"WITH {_NODES} SELECT * FROM n")
def jsonld_scan(spark: SparkSession, d: str) -> DataFrame:
    """A JSON-LD document with a node a line, written and read in splits. S05, S07, K03."""
    place = _place(spark)
    b.jsonld_lines(part_nodes(spark, d)).write.text(place)
    return _routed(b.scan_jsonld(spark, place))


@query("jsonld_document", f"WITH {_NODES} SELECT * FROM n")
def jsonld_document(spark: SparkSession, d: str) -> DataFrame:
    """The same written as one text, read whole. S05."""
    place = _place(spark)
    b.jsonld_lines(part_nodes(spark, d)).coalesce(1).write.text(place)
    return _routed(b.read_jsonld(spark, place))


@query("jsonl_sidecar", "SELECT p_partkey AS src, p_size AS dst, p_brand AS kind, p_name AS note FROM part")
def jsonl_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """References, items and enrichments as sorted JSON lines, and back. S09, S10, K07, K08, K09, K10."""
    place = _place(spark)
    rows = table(spark, d, "part").selectExpr("p_partkey AS src", "p_size AS dst", "p_brand AS kind", "p_name AS note")
    b.write_sorted_jsonl(rows, place, ["src", "dst", "kind"])
    return b.read_jsonl(spark, place, "src bigint, dst bigint, kind string, note string").drop("_corrupt_record")


def _files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), "doc_id")


@query(
    "bundle_verify",
    """WITH f AS (SELECT source || '/' || doc_id || '.txt' AS path, doc_id % 10 AS k FROM documents)
    SELECT path, CASE k WHEN 1 THEN 'missing' WHEN 2 THEN 'mismatch' END AS verdict FROM f WHERE k IN (1, 2)
    UNION ALL SELECT 'new/' || path, 'extra' FROM f WHERE k = 3""",
)
def bundle_verify(spark: SparkSession, d: str) -> DataFrame:
    """Files rebuilt from inventory and blobs, some lost, changed and added, then verified. K04, K11, J19, Q04."""
    files = _files(spark, d)
    inventory = files.select("path", F.sha2("content", 256).alias("sha256"), (F.col("doc_id") % 10).alias("k"))
    back = b.reconstruct(inventory.select("path", "sha256", "k"), b.blobs(files)).join(inventory.select("path", "k"), "path")
    changed = F.when(F.col("k") == 2, F.encode(F.lit("changed \x00"), "UTF-8")).otherwise(F.col("content"))
    kept = back.where("k <> 1").select("path", changed.alias("content"))
    extra = back.where("k = 3").select(F.concat(F.lit("new/"), "path").alias("path"), "content")
    return b.verify(inventory.select("path", "sha256"), kept.unionAll(extra))


@query("bundle_rebuilt", "SELECT source || '/' || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS sha256 FROM documents")
def bundle_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each file's content from its digest: every distinct content is kept once. K04, K11."""
    files = _files(spark, d)
    inventory = files.select("path", F.sha2("content", 256).alias("sha256"))
    return b.reconstruct(inventory, b.blobs(files)).select("path", F.sha2("content", 256).alias("sha256"))


# -- SPARQL

_P = f"PREFIX x: <{X}> "
ASKED: dict[str, tuple[str, str]] = {
    "filter": ("SELECT ?s ?n { ?s a x:Part ; x:size ?n FILTER(?n > 40) }", f"SELECT '{X}part/' || p_partkey AS s, CAST(p_size AS VARCHAR) AS n FROM part WHERE p_size > 40"),
    "group": ("SELECT ?b (COUNT(*) AS ?k) (MAX(?n) AS ?top) { ?s x:brand ?b ; x:size ?n } GROUP BY ?b HAVING(COUNT(*) > 1)",
              f"SELECT '{X}brand/' || replace(p_brand, '#', '-') AS b, CAST(count(*) AS VARCHAR) AS k, CAST(max(p_size) AS VARCHAR) AS top FROM part GROUP BY 1 HAVING count(*) > 1"),
    "optional": ("SELECT ?s ?n { ?s a x:Part OPTIONAL { ?s x:size ?n FILTER(?n < 10) } }",
                 f"SELECT '{X}part/' || p_partkey AS s, CASE WHEN p_size < 10 THEN CAST(p_size AS VARCHAR) END AS n FROM part"),
    "exists": ("SELECT ?s { ?s a x:Part FILTER NOT EXISTS { ?s x:size ?n FILTER(?n >= 5) } }", f"SELECT '{X}part/' || p_partkey AS s FROM part WHERE p_size < 5"),
    "path": ("SELECT DISTINCT ?t { ?s x:brand/^x:brand ?t . ?s x:size 7 }",
             f"SELECT DISTINCT '{X}part/' || a.p_partkey AS t FROM part a JOIN part z ON a.p_brand = z.p_brand WHERE z.p_size = 7"),
    "union": ("SELECT ?s { { ?s x:size 1 } UNION { ?s x:size 2 } }", f"SELECT '{X}part/' || p_partkey AS s FROM part WHERE p_size IN (1, 2)"),
}


def _sparql(name: str) -> None:
    asked, want = ASKED[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return sparql.select(part_triples(spark, d), _P + asked)

    run.__doc__ = f"A SELECT over triples: {name}. E15, P18."
    query(f"sparql_{name}", want)(run)


for _name in ASKED:
    _sparql(_name)


# -- decomposition

_CODE = """
f AS (SELECT p_partkey, 'm' || (p_partkey // 40) || '/' || CASE WHEN p_partkey % 7 = 0 THEN 'test_f' ELSE 'f' END || p_partkey || '.py' AS path,
             CASE WHEN p_partkey % 7 = 0 THEN 'test_code' WHEN p_partkey % 11 = 0 THEN 'generated' WHEN p_partkey % 13 = 0 THEN 'unknown' ELSE 'source_code' END AS type,
             'm' || (p_partkey // 40) AS module, p_size FROM part),
links AS (SELECT p_partkey AS k, p_partkey + 1 + p_size % 4 AS t FROM f WHERE p_size % 3 > 0
  UNION SELECT p_partkey, p_partkey - 3 FROM f WHERE p_size % 13 = 0
  UNION SELECT p_partkey, p_partkey + 40 + p_size % 9 FROM f WHERE p_size % 17 = 0
  UNION SELECT p_partkey, p_partkey - 80 FROM f WHERE p_size = 25),
e AS (SELECT a.path AS src, z.path AS dst, a.module AS sm, z.module AS dm, a.type AS st FROM links JOIN f a ON a.p_partkey = k JOIN f z ON z.p_partkey = t)"""


def code_tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files (path, type, language) in folders of forty: most import one further on, some one before, some another folder's."""
    k, n = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 7 == 0, "test_code").when(k % 11 == 0, "generated").when(k % 13 == 0, "unknown").otherwise("source_code")
    name = F.concat(F.lit("m"), F.floor(k / 40).cast("string"), F.lit("/"), F.when(k % 7 == 0, "test_f").otherwise("f"), k.cast("string"), F.lit(".py"))
    files = table(spark, d, "part").select("p_partkey", "p_size", name.alias("path"), kind.alias("type"), F.lit("python").alias("language"))
    to = F.array_compact(
        F.array(F.when(n % 3 > 0, k + 1 + n % 4), F.when(n % 13 == 0, k - 3), F.when(n % 17 == 0, k + 40 + n % 9), F.when(n == 25, k - 80))
    )
    a = files.select(F.col("path").alias("src"), F.explode(F.array_distinct(to)).alias("t"))
    edges = a.join(files.select(F.col("p_partkey").alias("t"), F.col("path").alias("dst")), "t").select("src", "dst")
    return files.drop("p_partkey", "p_size"), edges


def _ring(src: str, dst: str, links: str) -> str:
    """(n, c): each end of a link with the least one that it reaches and that reaches it."""
    return f"""WITH RECURSIVE r(a, b) AS (SELECT DISTINCT {src}, {dst} FROM {links} UNION SELECT r.a, x.{dst} FROM r JOIN {links} x ON x.{src} = r.b)
      SELECT x.a AS n, min(x.b) AS c FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1"""


@query(
    "decompose_gates",
    f"""WITH {_CODE}, roll AS (SELECT DISTINCT sm, dm FROM e WHERE sm <> dm),
    ca AS (SELECT dm AS m, count(DISTINCT sm) AS ca FROM roll GROUP BY 1), ce AS (SELECT sm AS m, count(DISTINCT dm) AS ce FROM roll GROUP BY 1)
    SELECT 'god_module' AS gate, 'warning' AS severity, 'module:' || m AS subject, 'strong' AS confidence, 'Ca=' || ca || ' Ce=' || ce AS evidence
      FROM ca JOIN ce USING (m) WHERE ca >= 6 AND ce >= 6
    UNION ALL SELECT 'dead_code_candidate', 'info', path, 'probable', 'xref_targeted=false' FROM f WHERE type = 'source_code' AND path NOT IN (SELECT dst FROM e)
    UNION ALL SELECT 'hidden_entrypoint', 'info', path, 'weak', 'imports_in=0 imports_out>0' FROM f
      WHERE type = 'source_code' AND path NOT IN (SELECT dst FROM e) AND path IN (SELECT src FROM e)
    UNION ALL SELECT 'generated_drives_architecture', 'warning', dst, 'strong', 'imports_in=' || count(*) FROM e JOIN f ON path = dst WHERE f.type = 'generated' GROUP BY dst
    UNION ALL SELECT 'test_gap', 'warning', 'module:' || module, 'probable', 'code_files=' || count(*) FROM f WHERE type = 'source_code'
      AND module NOT IN (SELECT dm FROM e WHERE st = 'test_code') GROUP BY module
    UNION ALL SELECT 'missing_evidence', 'info', 'file-type=unknown', 'certain', CAST(count(*) AS VARCHAR) FROM f WHERE type = 'unknown' HAVING count(*) > 0
    UNION ALL SELECT 'ambiguous_ownership', 'info', 'module:' || dm, 'probable', string_agg(DISTINCT sm, ',' ORDER BY sm) FROM roll GROUP BY dm HAVING count(DISTINCT sm) >= 2
    UNION ALL SELECT 'circular_dependency', 'warning', c, 'certain', 'files=' || count(*) FROM ({_ring('src', 'dst', 'e')}) GROUP BY c HAVING count(*) > 1
    UNION ALL SELECT 'directory_cycle', 'info', 'module:' || c, 'probable', 'directories=' || count(*) FROM ({_ring('sm', 'dm', 'roll')}) GROUP BY c HAVING count(*) > 1""",
)
def decompose_gates(spark: SparkSession, d: str) -> DataFrame:
    """Findings of a decomposition. Q05, Q07, U06, G07."""
    files, edges = code_tree(spark, d)
    none = files.limit(0).select("path")
    return dc.gates(files, edges, none.withColumn("concept", F.lit("")), none, none)


@query(
    "part_kinds",
    f"""WITH {_CODE} SELECT CASE WHEN type IN ('source_code', 'test_code') THEN 'module' WHEN type = 'generated' THEN 'generated_artifact' ELSE 'unclassified' END AS kind,
      CASE WHEN type IN ('source_code', 'test_code') THEN module ELSE type END AS part, count(*) AS n_files FROM f GROUP BY 1, 2""",
)
def part_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every file in one part, by type and folder. Q11, A33."""
    return dc.part_kinds(code_tree(spark, d)[0])


@query(
    "mutual_modules",
    f"""WITH {_CODE}, roll AS (SELECT DISTINCT sm, dm FROM e WHERE sm <> dm)
    SELECT 'bidirectional_coupling' AS kind, x.sm AS a, x.dm AS b FROM roll x JOIN roll y ON x.sm = y.dm AND x.dm = y.sm WHERE x.sm < x.dm""",
)
def mutual_modules(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the architecture: folders that import each other. Q06, J17."""
    return dc.architecture_violations(*code_tree(spark, d))


_PLAN = f"""{_CODE}, roll AS (SELECT DISTINCT sm, dm FROM e WHERE sm <> dm),
mods AS (SELECT DISTINCT module, CAST(substr(module, 2) AS INT) % 5 + 1 AS phase FROM f),
units AS (SELECT module, phase, coalesce(c, module) AS unit FROM mods LEFT JOIN ({_ring('sm', 'dm', 'roll')}) ON n = module),
ue AS (SELECT DISTINCT x.unit AS a, z.unit AS b FROM roll JOIN units x ON x.module = sm JOIN units z ON z.module = dm WHERE x.unit <> z.unit),
own AS (SELECT unit, min(phase) AS phase FROM units GROUP BY 1),
pulled AS (WITH RECURSIVE p(unit, phase) AS (SELECT unit, phase FROM own UNION SELECT b, p.phase FROM p JOIN ue ON a = p.unit) SELECT unit, min(phase) AS phase FROM p GROUP BY 1),
depth AS (WITH RECURSIVE l(unit, d) AS (SELECT unit, CAST(0 AS BIGINT) FROM own UNION SELECT a, d + 1 FROM l JOIN ue ON b = l.unit) SELECT unit, max(d) AS layer FROM l GROUP BY 1)"""


def _steps_sql(phases: str) -> str:
    return f"""(SELECT module, unit, p.phase, layer, step FROM units JOIN (SELECT unit, phase, layer, CAST(row_number() OVER (ORDER BY phase, layer, unit) AS INT) AS step
      FROM {phases} JOIN depth USING (unit)) p USING (unit))"""


def _phases(files: DataFrame) -> DataFrame:
    return dc.modules(files).select("module").distinct().withColumn("phase", F.substring("module", 2, 9).cast("int") % 5 + 1)


@query("build_plan", f"WITH {_PLAN} SELECT step, unit, module, phase, layer FROM {_steps_sql('pulled')}")
def build_plan(spark: SparkSession, d: str) -> DataFrame:
    """Folders in the order of their building, rings as one unit, phases of dependencies pulled down. G15, G16, W08, Q08."""
    files, edges = code_tree(spark, d)
    return dc.build_plan(files, edges, _phases(files))


@query(
    "forward_steps",
    f"""WITH {_PLAN}, s AS {_steps_sql('own')} SELECT sm, dm, x.step AS at, z.step AS needs FROM roll JOIN s x ON x.module = sm JOIN s z ON z.module = dm WHERE z.step > x.step""",
)
def forward_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of a plan by stated phases alone that need a later one; `build_plan` pulls phases so that there are none. Q08, G15."""
    files, edges = code_tree(spark, d)
    return dc.forward_dependencies(dc.build_plan(files, edges, _phases(files), relax=False), files, edges).select("sm", "dm", "at", "needs")


@query(
    "unit_steps",
    f"""WITH {_PLAN}, s AS {_steps_sql('pulled')}, made AS (SELECT step, f.path, type FROM f JOIN s USING (module)),
    need AS (SELECT DISTINCT x.step, z.step AS needs FROM e JOIN s x ON x.module = sm JOIN s z ON z.module = dm WHERE x.step <> z.step)
    SELECT step, string_agg(path, ',' ORDER BY path) AS creates, coalesce(string_agg(path, ',' ORDER BY path) FILTER (type = 'test_code'), '') AS tests,
      coalesce((SELECT string_agg(needs, ',' ORDER BY needs) FROM need WHERE need.step = made.step), '') AS requires FROM made GROUP BY step""",
)
def unit_steps(spark: SparkSession, d: str) -> DataFrame:
    """What each step of the plan makes and needs. Q09, Q10."""
    files, edges = code_tree(spark, d)
    found = dc.unit_steps(files, edges, dc.build_plan(files, edges, _phases(files)))
    return found.select("step", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("creates", "tests", "requires")])


@query(
    "file_claims",
    """WITH c AS (SELECT DISTINCT 'p' || l_partkey AS path, l_linenumber AS step FROM lineitem), m AS (SELECT path, min(step) AS first FROM c GROUP BY 1)
    SELECT path, step, CASE WHEN step = first THEN 'creates' ELSE 'modifies' END AS action FROM c JOIN m USING (path)""",
)
def file_claims(spark: SparkSession, d: str) -> DataFrame:
    """The first step that claims a file creates it, later ones modify it. Q08, W07."""
    claims = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_linenumber").alias("step"))
    return dc.creates_and_modifies(claims)


@query(
    "weakest_confidence",
    """WITH c AS (SELECT o_orderkey, o_custkey % 5 AS x, o_orderkey % 5 AS y FROM orders)
    SELECT o_orderkey, (['unknown', 'weak', 'probable', 'strong', 'certain'])[least(x, y) + 1] AS confidence FROM c""",
)
def weakest_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The less sure of two confidences. Q07."""
    names = F.array(*map(F.lit, ["unknown", "weak", "probable", "strong", "certain"]))
    x, y = (F.element_at(names, (F.col(c) % 5 + 1).cast("int")) for c in ("o_custkey", "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", dc.weakest(x, y).alias("confidence"))


# -- whole bundles


def _bundle(spark: SparkSession, d: str) -> str:
    place = _place(spark)
    part = table(spark, d, "part")
    tables = {
        "files": part.selectExpr("p_partkey AS id", "p_name AS path", "p_size AS size"),
        "concepts": part.select(F.explode(F.split("p_name", " ")).alias("name")).groupBy("name").agg(F.count("*").alias("frequency")),
        "chunks": part.selectExpr("p_partkey AS file", "p_brand AS kind", "p_type AS symbol"),
    }
    ar.emit(tables, part_triples(spark, d), place, {"source": "part"})
    return place


@query(
    "bundle_loaded",
    """SELECT 'files' AS name, count(*) AS n FROM part UNION ALL SELECT 'chunks', count(*) FROM part UNION ALL SELECT 'triples', 4 * count(*) FROM part
    UNION ALL SELECT 'concepts', count(DISTINCT c) FROM (SELECT unnest(string_split(p_name, ' ')) AS c FROM part)""",
)
def bundle_loaded(spark: SparkSession, d: str) -> DataFrame:
    """A bundle emitted, read again and checked against its manifest: rows of each table. K01, S12, S15, S16, K06."""
    tables = ar.load(spark, _bundle(spark, d))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out


@query("bundle_files", "SELECT p_partkey AS id, p_name AS path, p_size AS size FROM part")
def bundle_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of a loaded bundle. S12, S20."""
    return ar.load(spark, _bundle(spark, d))["files"]


@query("bundle_concepts", "SELECT c AS name, count(*) AS frequency FROM (SELECT unnest(string_split(p_name, ' ')) AS c FROM part) GROUP BY 1")
def bundle_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The concepts of a loaded bundle. K06, S16."""
    return ar.load(spark, _bundle(spark, d))["concepts"]


@query("bundle_chunks", "SELECT p_partkey AS file, p_brand AS kind, p_type AS symbol FROM part")
def bundle_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a loaded bundle. S16, J03."""
    return ar.load(spark, _bundle(spark, d))["chunks"]


@query("turtle_roundtrip", f"WITH {_TRIPLES} SELECT * FROM t")
def turtle_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Triples written as Turtle, a block for each subject, and read in splits. S06, S08, K02."""
    place = _place(spark)
    ar.turtle(part_triples(spark, d)).write.text(place)
    return ar.read_turtle(spark, place)


@query("vectors_kept", "SELECT vec_id AS id, CAST(i - 1 AS BIGINT) AS i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)")
def vectors_kept(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written with their digest and read again, component by component. K05, S11."""
    place = _place(spark)
    e = table(spark, d, "embeddings")
    ar.write_vectors(e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("v")), place, "given")
    kept = ar.read_vectors(spark, place).select("id", F.posexplode("v").alias("i", "x"))
    return kept.select("id", F.col("i").cast("bigint").alias("i"), F.col("x").cast("double").alias("x"))


@query(
    "cycle_resolutions",
    """WITH w(unit, path, layer, resolvable) AS (VALUES ('a', 'a/x', 1, true), ('a', 'a/w', 0, true), ('a', 'b/y', 0, true), ('a', 'b/z', 1, true), ('a', 'a/free', 0, true),
      ('c', 'c/x', NULL, false), ('c', 'd/y', NULL, false))
    SELECT 'r' || p_partkey || unit AS unit, 'r' || p_partkey || path AS path, layer, resolvable FROM part, w""",
)
def cycle_resolutions(spark: SparkSession, d: str) -> DataFrame:
    """Rings of modules and the order of their files, where there is one. G09."""
    keys = table(spark, d, "part").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("k"))
    names = ["a/x", "a/w", "a/free", "b/y", "b/z", "c/x", "d/y", "e/alone"]
    links = [("a/x", "b/y"), ("b/z", "a/w"), ("c/x", "d/y"), ("d/y", "c/x"), ("e/alone", "a/x")]
    files = keys.select(F.explode(F.transform(F.array(*map(F.lit, names)), lambda n: F.concat("k", n))).alias("path"))
    pairs = F.array(*(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for x, y in links))
    edges = keys.select("k", F.explode(pairs).alias("p")).select(F.concat("k", "p.a").alias("src"), F.concat("k", "p.b").alias("dst"))
    return dc.cycle_resolutions(files, edges)


# -- repair and evidence


def _graph_tables(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """parts and brands as tables, and the triples that say the same."""
    part = table(spark, d, "part")
    brand = F.replace("p_brand", F.lit("#"), F.lit("-"))
    tables = {
        "parts": part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit('"\\ \n')).alias("path"), F.col("p_size").alias("size"), F.array(brand).alias("brands")),
        "brands": part.groupBy(brand.alias("brand")).agg(F.array_sort(F.collect_set("p_type")).alias("kinds")),
    }
    null = F.lit(None).cast("string")

    def rows(df: DataFrame, s: Column, p: str, o: Column, kind: str = "literal") -> DataFrame:
        return df.select(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), null.alias("datatype"), null.alias("lang"))

    s, of = _iri("part", "id"), F.concat(F.lit(f"{X}brand/"), "brand")
    p, t = tables["parts"], tables["brands"]
    out = rows(p, s, A, F.lit(f"{X}Part"), "iri").unionAll(rows(p, s, f"{X}path", F.col("path"))).unionAll(rows(p, s, f"{X}size", F.col("size")))
    out = out.unionAll(rows(p, s, f"{X}brand", F.get("brands", 0))).unionAll(rows(t, of, A, F.lit(f"{X}Brand"), "iri"))
    return tables, out.unionAll(rows(t.select("brand", F.explode("kinds").alias("k")), of, f"{X}kind", F.col("k")))


SHAPES = {
    "parts": rb.Shape(f"{X}Part", "id", "bigint", f"{X}part/", (("path", f"{X}path", "string"), ("size", f"{X}size", "int"), ("brands", f"{X}brand", "array<string>"))),
    "brands": rb.Shape(f"{X}Brand", "brand", "string", f"{X}brand/", (("kinds", f"{X}kind", "array<string>"),)),
}


@query(
    "sidecars_rebuilt",
    """SELECT 'parts' AS name, true AS equal, CAST(p_partkey AS VARCHAR) AS key, p_name || '"\\ ' || chr(10) || '|' || p_size || '|' || replace(p_brand, '#', '-') AS content FROM part
    UNION ALL SELECT 'brands', true, replace(p_brand, '#', '-'), string_agg(DISTINCT p_type, ',' ORDER BY p_type) FROM part GROUP BY p_brand""",
)
def sidecars_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a bundle from its graph alone, with whether they are what its manifest says."""
    place = _place(spark)
    tables, triples = _graph_tables(spark, d)
    ar.emit(tables, triples, place, {"source": "part"})
    found, equal = rb.rebuild(spark, place, SHAPES)
    parts = found["parts"].select(
        F.lit("parts").alias("name"), F.lit(equal["parts"]).alias("equal"), F.col("id").cast("string").alias("key"),
        F.concat_ws("|", "path", F.col("size").cast("string"), F.array_join("brands", ",")).alias("content"),
    )
    brands = found["brands"].select(F.lit("brands"), F.lit(equal["brands"]), "brand", F.array_join("kinds", ","))
    return parts.unionAll(brands)


@query(
    "bundle_orientation",
    f"""WITH p(predicate) AS (VALUES (NULL), ('{X}path'), ('{X}size'), ('{X}brand')), b AS (SELECT count(DISTINCT p_brand) AS n, count(DISTINCT (p_brand, p_type)) AS v FROM part)
    SELECT '{X}Part' AS class, predicate, n AS subjects, n AS "values" FROM p, (SELECT count(*) AS n FROM part)
    UNION ALL SELECT '{X}Brand', NULL, n, n FROM b UNION ALL SELECT '{X}Brand', '{X}kind', n, v FROM b""",
)
def bundle_orientation(spark: SparkSession, d: str) -> DataFrame:
    """The classes and predicates of a bundle's graph, with how many subjects and values they have."""
    place = _place(spark)
    tables, triples = _graph_tables(spark, d)
    ar.emit(tables, triples, place, {"source": "part"})
    return gate.orient(ar.load(spark, place)["triples"])


MARKERS = ["re", "there", "her", "tion", "@", "+1", "ation the", "\n\n", "l'", ".*", "é", "the and"]


@query(
    "content_evidence",
    f"""WITH m AS (SELECT unnest([{", ".join("'" + m.replace("'", "''").replace(chr(10), "' || chr(10) || '") + "'" for m in MARKERS)}]) AS marker)
    SELECT lang || '/' || doc_id AS path, marker FROM documents, m WHERE contains(text, marker)""",
)
def content_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Which markers the contents of files have, each content searched once."""
    docs = table(spark, d, "documents").select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("digest"), "text")
    return rb.find_markers(docs.select("path", "digest"), docs.select("digest", "text"), MARKERS)
