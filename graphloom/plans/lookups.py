"""Queries of what resolvers look names up in, over repositories whose files depend on the columns of `part`; stable hashes; reachable triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.plans.registry import query
from graphloom.plans.tables import ORDER_EDGES_SQL, order_edges, table
from graphloom.sources import indexes as ix
from graphloom.sources import sparql

_GO = [("go.mod", "p_size % 3 = 0"), ("a/go.mod", "p_size % 2 = 0"), ("a/b/go.mod", "p_size % 5 = 0"), ("b/go.mod", "p_size % 7 = 0")]


@query(
    "go_modules",
    f"""WITH f AS ({" UNION ALL ".join(f"SELECT p_partkey, p_size, '{p}' AS path, {i} AS o FROM part WHERE {given}" for i, (p, given) in enumerate([_GO[0], _GO[1], _GO[3], _GO[2]]))}),
    m AS (SELECT p_partkey, any_value(p_size) AS n, arg_min(path, o) AS path FROM f GROUP BY 1)
    SELECT 'r' || p_partkey AS repo, 'ex.com/r' || p_partkey || '/' || path AS module, CASE path WHEN 'go.mod' THEN '' ELSE left(path, len(path) - 7) END AS dir
    FROM m WHERE (n + len(path)) % 11 <> 0""",
)
def go_modules(spark: SparkSession, d: str) -> DataFrame:
    """IX05: the module path of each repository, by the go.mod that counts, where it names one."""
    part = table(spark, d, "part")
    parts = [part.where(given).select("p_partkey", "p_size", F.lit(p).alias("path")) for p, given in _GO]
    files = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    repo = F.concat(F.lit("r"), F.col("p_partkey").cast("string"))
    line = F.concat(F.lit("// go\n\nmodule ex.com/"), repo, F.lit("/"), "path", F.lit("\ngo 1.2\n"))
    text = F.when((F.col("p_size") + F.length("path")) % 11 == 0, F.lit("go 1.2\n")).otherwise(line)
    return ix.go_modules(files.select(repo.alias("repo"), "path", text.alias("text")))


_JAVA = ["src/main/java/a/B.java", "svc/s{n}/src/test/java/T.java", "x/src/main/java/y{n}/src/main/java/Z.java", "lib/src/main/kotlin/src/test/java/K.java", "plain/{n}.java"]
_JAVA_WANT = [["src/main/java"], ["svc/s{n}/src/test/java"], ["x/src/main/java/y{n}/src/main/java"], ["lib/src/main/kotlin", "lib/src/main/kotlin/src/test/java"], []]


@query(
    "java_roots",
    "WITH w(k, root) AS (VALUES "
    + ", ".join(f"({i}, '{r}')" for i, v in enumerate(_JAVA_WANT) for r in v)
    + """) SELECT p_brand AS repo, replace(root, '{n}', CAST(p_size AS VARCHAR)) AS root FROM part JOIN w ON k = p_partkey % 5 WHERE p_size % 13 <> 0 GROUP BY ALL""",
)
def java_roots(spark: SparkSession, d: str) -> DataFrame:
    """IX09: the folders that Java packages are counted from."""
    path = F.replace(F.get(F.array(*map(F.lit, _JAVA)), (F.col("p_partkey") % 5).cast("int")), F.lit("{n}"), F.col("p_size").cast("string"))
    language = F.when(F.col("p_size") % 13 == 0, "text").otherwise("java")
    return ix.java_roots(table(spark, d, "part").select(F.col("p_brand").alias("repo"), path.alias("path"), language.alias("language")))


_KINDS = ["class", "struct", "category", "class_interface", "function", "macro", "protocol", "category_impl"]


@query(
    "symbol_files",
    f"""WITH i AS (SELECT CASE p_size % 2 WHEN 0 THEN 'cpp' ELSE 'objective-c' END AS language, 'd/' || p_partkey AS path,
      ({_KINDS})[p_partkey % 8 + 1] AS kind, p_brand || CASE WHEN p_partkey % 8 IN (2, 7) THEN '(' || p_size || ')' ELSE '' END AS name FROM part WHERE p_partkey % 3 > 0)
    SELECT DISTINCT language, name, path FROM i WHERE language = 'cpp' AND kind IN ('class', 'struct', 'function')
    UNION SELECT language, name, path FROM i WHERE language <> 'cpp' AND kind IN ('class_interface', 'protocol', 'function', 'category', 'category_impl')
    UNION SELECT language, string_split(name, '(')[1], path FROM i WHERE language <> 'cpp' AND kind IN ('category', 'category_impl')""",
)
def symbol_files(spark: SparkSession, d: str) -> DataFrame:
    """IX12, IX13: the files that define a name at their top, in C++ and Objective-C."""
    k = (F.col("p_partkey") % 8).cast("int")
    name = F.when(k.isin(2, 7), F.concat("p_brand", F.lit("("), F.col("p_size").cast("string"), F.lit(")"))).otherwise(F.col("p_brand"))
    items = table(spark, d, "part").select(
        F.when(F.col("p_size") % 2 == 0, "cpp").otherwise("objective-c").alias("language"),
        F.concat(F.lit("d/"), F.col("p_partkey").cast("string")).alias("path"),
        F.get(F.array(*map(F.lit, _KINDS)), k).alias("kind"),
        name.alias("name"),
        F.when(F.col("p_partkey") % 3 == 0, "Outer").alias("parent"),
    )
    found = [ix.symbol_index(items, x).select(F.lit(x).alias("language"), "name", "path") for x in ("cpp", "objective-c")]
    return found[0].unionAll(found[1])


@query(
    "item_facets",
    """WITH p AS (SELECT *, p_partkey % 10 = 0 AS bad, p_partkey % 10 = 1 AS blank FROM part), g AS (SELECT * FROM p WHERE NOT bad AND NOT blank)
    SELECT 'total' AS facet, 'malformed' AS value, count(*) AS n FROM p WHERE bad HAVING count(*) > 0
    UNION ALL SELECT 'total', 'items', count(*) FROM g UNION ALL SELECT 'total', 'public', count(*) FROM g WHERE p_size % 2 = 0 UNION ALL SELECT 'total', 'async', count(*) FROM g WHERE p_size % 5 = 0
    UNION ALL SELECT 'kind', CASE WHEN p_size % 7 = 0 THEN '(unknown)' ELSE p_brand END, count(*) FROM g GROUP BY 2
    UNION ALL SELECT 'folder', CASE WHEN p_size % 3 = 0 THEN '(root)' ELSE 'd' || p_size END, count(*) FROM g GROUP BY 2
    UNION ALL SELECT 'attribute', a, count(*) FROM (SELECT unnest(string_split(p_name, ' ')) AS a FROM g) GROUP BY 2""",
)
def item_facets(spark: SparkSession, d: str) -> DataFrame:
    """Facets of item lines, good ones and broken ones."""
    part, k = table(spark, d, "part"), F.col("p_partkey") % 10
    path = F.when(F.col("p_size") % 3 == 0, "f.rs").otherwise(F.concat(F.lit("d"), F.col("p_size").cast("string"), F.lit("/x/f.rs")))
    item = F.to_json(
        F.struct(
            path.alias("path"), F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("kind"), F.col("p_name").alias("name"), (F.col("p_size") % 2 == 0).alias("is_pub"),
            (F.col("p_size") % 5 == 0).alias("is_async"), F.split("p_name", " ").alias("attributes"),
        )
    )
    line = F.when(k == 0, F.concat(F.lit('{"path": '), "p_name")).when(k == 1, "  ").otherwise(item)
    return ix.item_facets(part.select(line.alias("value")))


@query(
    "stable_hashes",
    """WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN 'é€' WHEN 1 THEN '' ELSE '日' END AS s FROM part)
    SELECT p_partkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(s, ''), lambda c: CAST(unicode(c) AS BIGINT))),
      lambda h, x: (xor(h, x) * 16777619) % 4294967296) AS h FROM t""",
)
def stable_hashes(spark: SparkSession, d: str) -> DataFrame:
    """FNV-1a over UTF-16 units."""
    end = F.when(F.col("p_partkey") % 3 == 0, "é€").when(F.col("p_partkey") % 3 == 1, "").otherwise("日")
    return table(spark, d, "part").select("p_partkey", tx.fnv1a(F.concat("p_name", end)).alias("h"))


X = "http://x/"


@query(
    "sparql_reach",
    f"""WITH RECURSIVE {ORDER_EDGES_SQL}, r(n) AS (SELECT dst FROM edges WHERE src = 107 UNION SELECT dst FROM r JOIN edges ON src = n),
    b(n) AS (SELECT src FROM edges WHERE dst = 118 UNION SELECT src FROM b JOIN edges ON dst = n)
    SELECT 'from' AS side, '{X}o/' || n AS t FROM r UNION ALL SELECT 'to', '{X}o/' || n FROM b""",
)
def sparql_reach(spark: SparkSession, d: str) -> DataFrame:
    """Paths of any length from one node and to one, walked from the end that is known."""
    null = F.lit(None).cast("string")
    iri = lambda c: F.concat(F.lit(f"{X}o/"), F.col(c).cast("string"))
    triples = order_edges(spark, d).select(
        iri("src").alias("s"), F.lit(f"{X}uses").alias("p"), iri("dst").alias("o"), F.lit("iri").alias("o_kind"), null.alias("datatype"), null.alias("lang")
    )
    asked = {"from": f"<{X}o/107> <{X}uses>+ ?t", "to": f"?t <{X}uses>+ <{X}o/118>"}
    out = [sparql.select(triples, f"SELECT ?t {{ {q} }}").select(F.lit(k).alias("side"), "t") for k, q in asked.items()]
    return out[0].unionAll(out[1])
