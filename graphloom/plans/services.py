"""Queries of composite answers, selections and identifiers over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import relational as op
from graphloom.operators import services as sv
from graphloom.operators.scratch import checkpoint_dir
from graphloom.plans.codebase import sql_rows
from graphloom.plans.imports import repositories
from graphloom.operators.setjoin import pairs_within
from graphloom.plans.registry import query
from graphloom.plans.tables import EDGES_SQL, edges, table

#: path, language, text, language after retagging; of a repository with all languages, and of one with C alone.
HEADERS = [
    ("a/x.m", "objective-c", "@end", "objective-c"), ("a/x.h", "c", "int a;", "objective-c"), ("inc/y.h", "c", "\n@interface Y{n}\n@end", "objective-c"),
    ("inc/z.h", "c", "int z;", "c"), ("k/w.c", "c", "", "c"), ("k/w.h", "c", "@interface W", "c"), ("q/q.cpp", "cpp", "", "cpp"), ("q/q.h", "c", "int q;", "cpp"),
    ("inc/t.h", "c", "#pragma once\nnamespace t {\n}", "cpp"), ("k/v.h", "c", "template <class T>", "c"),
]
PLAIN = [("p/a.c", "c", "", "c"), ("i/a.h", "c", "@interface A", "c"), ("i/b.h", "c", "namespace b {", "c")]


@query(
    "header_languages",
    f"""WITH w(path, language) AS (VALUES {sql_rows([(p, x) for p, _, _, x in HEADERS])}), v(path, language) AS (VALUES {sql_rows([(p, x) for p, _, _, x in PLAIN])})
    SELECT CAST(p_partkey AS VARCHAR) AS repo, path, language FROM part, w UNION ALL SELECT 'plain' || p_partkey, path, language FROM part, v""",
)
def header_languages(spark: SparkSession, d: str) -> DataFrame:
    """Headers of Objective-C and C++ told from those of C, in every repository. P05."""
    mixed = repositories(spark, d, [h[:3] for h in HEADERS], "path, language, text")
    plain = repositories(spark, d, [h[:3] for h in PLAIN], "path, language, text").withColumn("repo", F.concat(F.lit("plain"), "repo"))
    return sv.header_languages(mixed.unionByName(plain))


@query(
    "test_owned_files",
    """SELECT 'r' || p_partkey || x AS path FROM part, (VALUES ('/tests/a.py'), ('/tests/deep/b.py'), ('/fix/pubspec.yaml')) t(x)""",
)
def test_owned_files(spark: SparkSession, d: str) -> DataFrame:
    """Files below a test module, and roots of packages that hold test modules alone. P22."""
    files = repositories(spark, d, [(f"r{{n}}/{p}",) for p in ("tests/a.py", "tests/deep/b.py", "fix/pubspec.yaml", "ui/c.js", "src/d.py", "ui/lib/e.js")], "path")
    roles = [("r{n}/tests", "test"), ("r{n}/fix/lib", "test"), ("r{n}/fix/bin", "test"), ("r{n}/ui/__tests__", "test"), ("r{n}/ui/lib", "runtime"), ("r{n}/src", "runtime")]
    return sv.test_owned(files.select("path"), repositories(spark, d, roles, "module, role"))


@query(
    "chunk_id_parts",
    """SELECT 'a/f' || p_partkey || '.py' AS path, CASE WHEN p_partkey % 3 = 0 THEN 'chunk' ELSE 'method' END AS kind,
      CASE WHEN p_partkey % 3 = 0 THEN 'odd' || p_partkey ELSE 'K:c.m' || p_partkey END AS symbol,
      CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS b, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size + 5 END AS e FROM part""",
)
def chunk_id_parts(spark: SparkSession, d: str) -> DataFrame:
    """Chunk ids taken apart. F18."""
    k = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("a/f"), k, F.lit(".py#"))
    end = F.when(F.col("p_partkey") % 3 == 1, F.lit(":b1-2")).otherwise("")
    full = F.concat(path, F.lit("method:K:c.m"), k, F.lit(":L"), F.col("p_size").cast("string"), F.lit("-L"), (F.col("p_size") + 5).cast("string"), end)
    ids = F.when(F.col("p_partkey") % 3 == 0, F.concat(path, F.lit("odd"), k)).otherwise(full)
    return table(spark, d, "part").select(sv.chunk_parts(ids).alias("x")).select("x.*")


@query("parse_error_counts", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN 0 ELSE 0 END AS n FROM part")
def parse_error_counts(spark: SparkSession, d: str) -> DataFrame:
    """Errors counted in lists of diagnostics, well-formed or not. F21."""
    n = F.col("p_size").cast("string")
    good = F.array(F.lit("parse_errors_present"), F.concat(F.lit("parse_error_nodes:"), n), F.lit("parse_error_nodes:7"))
    bad = F.array(F.lit("parse_error_nodes:"), F.concat(F.lit("parse_error_nodes:x"), n))
    errors = F.when(F.col("p_partkey") % 3 == 0, good).when(F.col("p_partkey") % 3 == 1, bad).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", sv.parse_error_count(errors).alias("n"))


@query(
    "compound_order",
    """WITH c AS (SELECT 'c' || p_partkey AS u, string_split(p_name, ' ') AS w FROM part)
    SELECT u || '_' || w[1] || '_' || w[2] || CASE WHEN len(u) % 2 = 0 THEN '_compound' ELSE '' END AS id, u || ',' || w[1] || '_' || w[2] AS parts FROM c""",
)
def compound_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of a compound's parts, found in its name. F19."""
    w = F.split("p_name", " ")
    unit = F.concat(F.lit("c"), F.col("p_partkey").cast("string"))
    pair = F.concat_ws("_", F.get(w, F.lit(0)), F.get(w, F.lit(1)))
    end = F.when(F.length(unit) % 2 == 0, "_compound").otherwise("")
    rows = table(spark, d, "part").select(F.concat(unit, F.lit("_"), pair, end).alias("id"), F.array_sort(F.array(pair, unit)).alias("parts"))
    return sv.compound_parts(rows).select("id", F.array_join("parts", ",").alias("parts"))


@query(
    "vocabulary_terms",
    """SELECT lower(n_name) AS term, CASE n_regionkey % 3 WHEN 0 THEN 'domain-primitive' WHEN 1 THEN 'structural-primitive' ELSE 'relational-primitive' END AS kind,
      CASE WHEN n_regionkey % 3 = 0 THEN 'root' END AS broader, lower(a) AS alias FROM nation, (VALUES (0), (1)) t(x), LATERAL (SELECT CASE WHEN x = 0 THEN n_name ELSE n_name || '-alias' END AS a)""",
)
def vocabulary_terms(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary in YAML, checked and read as a table of terms and aliases. S18."""
    rows = table(spark, d, "nation").select("n_name", "n_regionkey").orderBy("n_name").collect()  # a vocabulary is small
    lines = ["version: 1", "broader: {domain-primitive: root}", "kinds:"]
    for k, kind in enumerate(sv.TERM_KINDS):
        lines += [f"  {kind}:", *(f'    - "{r.n_name}"' for r in rows if r.n_regionkey % 3 == k)]
    lines += ["aliases:", *(f'  "{r.n_name}": ["{r.n_name}-Alias"]' for r in rows)]
    return spark.createDataFrame(sv.vocabulary("\n".join(lines)), "term string, kind string, broader string, alias string")


@query(
    "described_concepts",
    """WITH c AS (SELECT p_type AS name, count(*) AS f, count(DISTINCT p_brand) AS b, CASE WHEN p_type LIKE '%BRASS' THEN 'k' END AS kind FROM part GROUP BY p_type)
    SELECT name, 'vocab' AS tier FROM c WHERE kind IS NOT NULL
    UNION ALL (SELECT name, 'corpus_top' FROM c WHERE kind IS NULL ORDER BY f DESC, b DESC, name LIMIT 12)""",
)
def described_concepts(spark: SparkSession, d: str) -> DataFrame:
    """All terms of a vocabulary, and the most frequent of the rest. O09, O04."""
    c = table(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("frequency"), F.count_distinct("p_brand").alias("file_count"))
    return sv.two_tiers(c.withColumn("kind", F.when(F.col("name").like("%BRASS"), "k")), 12)


_INDEX = """
i AS (SELECT p_name AS title, 'f' || p_partkey AS url, 'file' AS kind, p_brand AS hint FROM part
  UNION ALL SELECT DISTINCT p_type, 'c/' || p_type, 'concept', NULL FROM part
  UNION ALL SELECT n_name, 'n' || n_nationkey, 'page', n_name || ' tin' FROM nation)"""


def site_index(spark: SparkSession, d: str) -> DataFrame:
    """(title, url, kind, hint) of everything that can be found."""
    p, n = table(spark, d, "part"), table(spark, d, "nation")
    null = F.lit(None).cast("string")
    files = p.select(F.col("p_name").alias("title"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("url"), F.lit("file").alias("kind"), F.col("p_brand").alias("hint"))
    concepts = p.select("p_type").distinct().select(F.col("p_type"), F.concat(F.lit("c/"), "p_type"), F.lit("concept"), null)
    pages = n.select("n_name", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.lit("page"), F.concat("n_name", F.lit(" tin")))
    return files.unionAll(concepts).unionAll(pages)


@query("site_index", f"WITH {_INDEX} SELECT * FROM i")
def site_index_query(spark: SparkSession, d: str) -> DataFrame:
    """A flat index of pages, files and concepts. E17."""
    return site_index(spark, d)


@query(
    "site_search",
    f"""WITH {_INDEX}, h AS (SELECT *, strpos(lower(title), 'tin') AS pos FROM i WHERE strpos(lower(title), 'tin') > 0 OR strpos(lower(coalesce(hint, '')), 'tin') > 0),
    s AS (SELECT *, (CASE WHEN pos = 1 THEN 0 WHEN pos > 1 THEN 1 ELSE 2 END) * 10 + CASE kind WHEN 'page' THEN 0 WHEN 'file' THEN 3 ELSE 4 END AS score FROM h),
    r AS (SELECT *, row_number() OVER (ORDER BY score, length(title), title, url) AS place, count(*) OVER () AS total FROM s)
    SELECT title, url, kind, hint, CAST(score AS INT) AS score, CAST(place AS INT) AS place, total FROM r WHERE place <= 100""",
)
def site_search(spark: SparkSession, d: str) -> DataFrame:
    """The best hundred hits of a text in titles and hints. O13."""
    return sv.site_search(site_index(spark, d), " Tin ")


@query(
    "filtered_files",
    """SELECT p_partkey, p_name, p_brand FROM part WHERE strpos(lower(p_partkey || '|' || p_name || '|' || p_brand), 'brand#1') > 0
    ORDER BY p_name DESC, p_partkey, p_brand LIMIT 40""",
)
def filtered_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a text in any column, by a chosen column downwards. O14."""
    return sv.filter_rows(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "Brand#1", "p_name", True, 40)


@query(
    "most_connected",
    f"""WITH {EDGES_SQL}, m AS (SELECT p_partkey AS n, p_brand AS m FROM part), roll AS (SELECT DISTINCT a.m AS sm, z.m AS dm FROM edges JOIN m a ON a.n = src JOIN m z ON z.n = dst WHERE a.m <> z.m),
    c AS (SELECT coalesce(x.m, y.m) AS module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM (SELECT dm AS m, count(*) AS ca FROM roll GROUP BY 1) x
      FULL JOIN (SELECT sm AS m, count(*) AS ce FROM roll GROUP BY 1) y ON x.m = y.m)
    SELECT module, CAST(ca AS BIGINT) AS ca, CAST(ce AS BIGINT) AS ce FROM c ORDER BY ca + ce DESC, module LIMIT 12""",
)
def most_connected(spark: SparkSession, d: str) -> DataFrame:
    """The twelve modules with the most neighbours either way. O15."""
    m = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("module"))
    c = op.coupling(op.module_edges(edges(spark, d), m))
    return c.select("module", F.col("ca").cast("bigint").alias("ca"), F.col("ce").cast("bigint").alias("ce")).orderBy(F.desc(F.col("ca") + F.col("ce")), "module").limit(12)


@query("inheritance_depth", "SELECT p_partkey AS node, CAST(length(to_base(p_partkey, 8)) - 1 AS INT) AS depth FROM part WHERE p_partkey > 0")
def inheritance_depth(spark: SparkSession, d: str) -> DataFrame:
    """How deep each class lies below one without a base; a class has the base of an eighth of its number. G13."""
    k = table(spark, d, "part").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 8).alias("base"))
    return sv.inheritance_depth(k.where("base > 0"))


@query(
    "keystone",
    f"""WITH {EDGES_SQL}, i AS (SELECT dst AS k, count(*) AS n FROM edges GROUP BY 1), s AS (SELECT ps.p_partkey AS k, p_size AS n FROM part ps)
    SELECT 'f' || i.k AS path, i.n * s.n AS score FROM i JOIN s ON s.k = i.k WHERE s.n >= 3 ORDER BY score DESC, path LIMIT 1""",
)
def keystone(spark: SparkSession, d: str) -> DataFrame:
    """The file that is imported the most and holds the most. O07."""
    name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    part = table(spark, d, "part")
    e = edges(spark, d).select(name("src").alias("src"), name("dst").alias("dst"))
    symbols = part.select(name("p_partkey").alias("path"), F.explode(F.sequence(F.lit(1), "p_size")).alias("symbol"))
    return sv.keystone(part.select(name("p_partkey").alias("path")), e, symbols)


@query(
    "interchanges",
    f"""WITH {EDGES_SQL} SELECT dst AS path, count(DISTINCT a.p_brand) AS n FROM edges JOIN part a ON a.p_partkey = src JOIN part z ON z.p_partkey = dst
    WHERE z.p_brand = 'Brand#11' AND a.p_brand <> 'Brand#11' GROUP BY 1 HAVING count(DISTINCT a.p_brand) >= 2""",
)
def interchanges(spark: SparkSession, d: str) -> DataFrame:
    """Files of the core that several subsystems import. A17."""
    s = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("subsystem"))
    return sv.interchanges(edges(spark, d), s, "Brand#11")


@query(
    "unique_bases",
    """WITH c AS (SELECT p_partkey AS path, p_brand || CASE WHEN p_partkey % 3 > 0 THEN p_partkey ELSE p_size END AS name FROM part), u AS (SELECT name, min(path) AS target FROM c GROUP BY 1 HAVING count(*) = 1)
    SELECT o_orderkey AS path, 'o' || o_orderkey AS child, target FROM orders JOIN c ON c.path = o_custkey % 50 + 1 JOIN u USING (name)""",
)
def unique_bases(spark: SparkSession, d: str) -> DataFrame:
    """Bases found by names that one class alone bears. J20."""
    number = F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey")).otherwise(F.col("p_size"))  # some names are borne by several
    classes = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.concat("p_brand", number.cast("string")).alias("name"))
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50 + 1).alias("k"))
    derived = o.join(classes.select(F.col("path").alias("k"), F.col("name").alias("base")), "k")
    return sv.unique_bases(derived.select(F.col("o_orderkey").alias("path"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("child"), "base"), classes)


@query(
    "file_details",
    f"""WITH {EDGES_SQL}, o AS (SELECT src AS k, string_agg(DISTINCT dst, ',' ORDER BY dst) AS v FROM edges GROUP BY 1),
    i AS (SELECT dst AS k, string_agg(DISTINCT src, ',' ORDER BY src) AS v FROM edges GROUP BY 1),
    x AS (SELECT l_partkey AS k, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS v FROM lineitem GROUP BY 1)
    SELECT p_partkey AS path, coalesce(o.v, '') AS imports_out, coalesce(i.v, '') AS imports_in, coalesce(x.v, '') AS external_imports,
      'c' || p_partkey AS chunks, coalesce(list_aggregate(list_transform(string_split(nullif(o.v, ''), ','), lambda z: 'c' || z), 'string_agg', ','), '') AS xrefs_out
    FROM part LEFT JOIN o ON o.k = p_partkey LEFT JOIN i ON i.k = p_partkey LEFT JOIN x ON x.k = p_partkey""",
)
def file_details(spark: SparkSession, d: str) -> DataFrame:
    """Everything about each file: imports both ways, packages, chunks and references. E06, P14, P16."""
    e = edges(spark, d)
    c = lambda x: F.concat(F.lit("c"), F.col(x).cast("string"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("path"))
    external = table(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_returnflag").alias("package"))
    chunks = part.select("path", c("path").alias("chunk"))
    found = sv.file_details(part, e, external, chunks, e.select(c("src").alias("src"), c("dst").alias("dst")))
    by_number = F.array_sort(F.transform("xrefs_out", lambda x: F.substring(x, 2, 20).cast("bigint")))
    return found.select(
        "path", *(F.array_join(F.col(n).cast("array<string>"), ",").alias(n) for n in ("imports_out", "imports_in", "external_imports", "chunks")),
        F.array_join(F.transform(by_number, lambda n: F.concat(F.lit("c"), n.cast("string"))), ",").alias("xrefs_out"),
    )


@query(
    "concept_details",
    """WITH m AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS c, p_partkey AS path FROM part),
    f AS (SELECT c, path, row_number() OVER (PARTITION BY c ORDER BY path) AS r, count(*) OVER (PARTITION BY c) AS n FROM m),
    pr AS (SELECT x.c AS a, y.c AS b, count(*) AS w FROM m x JOIN m y ON x.path = y.path AND x.c < y.c GROUP BY 1, 2),
    bw AS (SELECT a AS c, b AS name, w FROM pr UNION ALL SELECT b, a, w FROM pr),
    near AS (SELECT c, string_agg(name, ',' ORDER BY w DESC, name) AS v FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY w DESC, name) AS r FROM bw) WHERE r <= 5 GROUP BY 1)
    SELECT f.c AS concept, any_value(n) AS file_count, string_agg(path, ',' ORDER BY path) AS files, any_value(coalesce(near.v, '')) AS cooccurring
    FROM f LEFT JOIN near ON near.c = f.c WHERE r <= 10 GROUP BY 1""",
)
def concept_details(spark: SparkSession, d: str) -> DataFrame:
    """Each concept with its first files and heaviest neighbours. E11."""
    m = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("concept"), F.col("p_partkey").alias("path"))
    pairs = pairs_within(m.select(F.col("path").alias("file"), "concept"), "file", "concept", 1).withColumnRenamed("n", "weight")
    found = sv.concept_details(m, pairs, 10, 5)
    return found.select("concept", "file_count", F.array_join(F.col("files").cast("array<string>"), ",").alias("files"), F.array_join("cooccurring", ",").alias("cooccurring"))


@query(
    "repository_summary",
    f"""WITH {EDGES_SQL}, deg AS (SELECT n AS k, count(*) AS t FROM (SELECT src AS n FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)
    SELECT 'files' AS section, 'total' AS name, count(*) AS value FROM part UNION ALL SELECT 'imports', 'total', count(*) FROM edges
    UNION ALL SELECT 'language', p_type, count(*) FROM part GROUP BY 2
    UNION ALL (SELECT 'central', 'f' || k, t FROM deg ORDER BY t DESC, k LIMIT 5)
    UNION ALL (SELECT 'concept', c, count(*) FROM (SELECT unnest(string_split(p_name, ' ')) AS c FROM part) GROUP BY c ORDER BY count(*) DESC, c LIMIT 5)""",
)
def repository_summary(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of a repository, its central files and its concepts, in one table. E02, E03."""
    part, e = table(spark, d, "part"), edges(spark, d)
    row = lambda section, name, value: (F.lit(section).alias("section"), name.alias("name"), value.alias("value"))
    out = part.agg(F.count("*").alias("n")).select(*row("files", F.lit("total"), F.col("n")))
    out = out.unionAll(e.agg(F.count("*").alias("n")).select(*row("imports", F.lit("total"), F.col("n"))))
    out = out.unionAll(part.groupBy("p_type").agg(F.count("*").alias("n")).select(*row("language", F.col("p_type"), F.col("n"))))
    top = op.degrees(e).orderBy(F.desc("total"), "node").limit(5)
    out = out.unionAll(top.select(*row("central", F.concat(F.lit("f"), F.col("node").cast("string")), F.col("total"))))
    words = part.select(F.explode(F.split("p_name", " ")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return out.unionAll(words.orderBy(F.desc("n"), "c").limit(5).select(*row("concept", F.col("c"), F.col("n"))))


@query("listed_bundles", "SELECT p_type AS bundle, count(*) AS files, sum(p_size) AS size FROM part GROUP BY 1")
def listed_bundles(spark: SparkSession, d: str) -> DataFrame:
    """The manifests of all bundles below a folder. S13, E04."""
    place = f"{checkpoint_dir(spark)}/bundles-{uuid.uuid4().hex}"
    made = table(spark, d, "part").groupBy(F.col("p_type").alias("bundle")).agg(F.count("*").alias("files"), F.sum("p_size").alias("size"))
    made.write.partitionBy("bundle").json(place)
    return spark.read.schema("files bigint, size bigint, bundle string").json(place).select("bundle", "files", "size")


@query(
    "memoised_answers",
    """SELECT p_partkey, CASE WHEN p_brand < 'Brand#3' THEN 'known' ELSE upper(p_brand) END AS value FROM part""",
)
def memoised_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a slow function, from its memory where it was asked before. X06."""
    key = sv.memo_key(F.lit("summary"), F.lit("m1"), F.lit("prompt"), F.col("p_brand"))
    requests = table(spark, d, "part").select("p_partkey", "p_brand", key.alias("key"))
    memory = requests.where("p_brand < 'Brand#3'").select("key").distinct().withColumn("value", F.lit("known"))
    answers, _ = sv.memoised(requests, memory, lambda missing: missing.withColumn("value", F.upper("p_brand")))
    return answers.select("p_partkey", "value")


@query(
    "inverted_map",
    """SELECT p_brand AS key, string_agg(p_partkey, ',' ORDER BY p_partkey) AS value FROM part GROUP BY 1""",
)
def inverted_map(spark: SparkSession, d: str) -> DataFrame:
    """A map from parts to brands, turned round. F13."""
    m = table(spark, d, "part").select(F.create_map("p_partkey", "p_brand").alias("m"))
    turned = m.select(F.explode("m").alias("v", "k")).groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("v"))
    return turned.select(F.col("k").alias("key"), F.array_join(F.col("v").cast("array<string>"), ",").alias("value"))


@query("inline_tests", "SELECT count(*) AS n FROM part WHERE p_partkey % 4 < 2")
def inline_tests(spark: SparkSession, d: str) -> DataFrame:
    """Rust files with a test inside of them. A34."""
    k = F.pmod("p_partkey", F.lit(4))
    text = F.when(k == 0, "#[test]\nfn a() {}").when(k == 1, "#[cfg(test)]\nmod t {\n  #[tokio::test]\n  async fn b() {}\n}").when(k == 2, "// #[test]\nfn c() {}").otherwise("#[testing]\nfn d() {}")
    marked = r"(?m)^\s*#\[(?:\w+::)*test(?:\([^\]]*\))?\]\s*(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\b"
    return table(spark, d, "part").where(text.rlike(marked)).agg(F.count("*").alias("n"))
