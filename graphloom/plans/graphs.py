"""Queries of the graph, vector and text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import community as cm
from graphloom.operators import forest as fo
from graphloom.operators import graph as g
from graphloom.operators import paths as pa
from graphloom.operators import relational as op
from graphloom.operators import vectors as v
from graphloom.operators.components import connected_components
from graphloom.operators.scratch import materialize
from graphloom.operators.setjoin import pairs_within
from graphloom.plans.registry import query
from graphloom.plans.tables import EDGES_SQL, ORDER_EDGES_SQL, all_edges, edges, order_edges, table

# -- walks


def _walk_sql(start: str, depth: int, back: bool = False) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f"""w AS (SELECT node, min(depth) AS depth FROM (
      WITH RECURSIVE r(node, depth) AS (SELECT {start} AS node, 0 AS depth
        UNION SELECT {b}, depth + 1 FROM r JOIN edges ON {a} = node WHERE depth < {depth}) SELECT * FROM r)
      GROUP BY node HAVING min(depth) > 0)"""


@query("walk_paths", f"WITH RECURSIVE {EDGES_SQL}, {_walk_sql('1', 4)} SELECT node, depth FROM w")
def walk_paths(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within four steps of one."""
    start = spark.createDataFrame([(1,)], "node bigint")
    return g.walk(edges(spark, d), start, 4)


@query(
    "file_impact",
    f"""WITH RECURSIVE {EDGES_SQL}, {_walk_sql('1', 3)}, {_walk_sql('1', 3, True).replace('w AS', 'x AS', 1)}
    SELECT 'depends_on' AS side, node, depth, p_name FROM w JOIN part ON p_partkey = node
    UNION ALL SELECT 'dependent', node, depth, p_name FROM x JOIN part ON p_partkey = node""",
)
def file_impact(spark: SparkSession, d: str) -> DataFrame:
    """What a file depends on and what depends on it, three steps each way."""
    e, start = edges(spark, d), spark.createDataFrame([(1,)], "node bigint")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_name")
    out = g.walk(e, start, 3).withColumn("side", F.lit("depends_on"))
    into = g.walk(back, start, 3).withColumn("side", F.lit("dependent"))
    return out.unionAll(into).join(names, "node").select("side", "node", "depth", "p_name")


def _limited_sql(start: int, depth: int, limit: int) -> str:
    """The levels written out: what is new on each, in the order of the least place of a parent, then of the key."""
    out = f"WITH {EDGES_SQL}, l0 AS (SELECT CAST({start} AS BIGINT) AS node, CAST(0 AS BIGINT) AS ord)"
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM l{j}" for j in range(i))
        out += f""", n{i} AS (SELECT dst AS node, min(ord) AS p FROM l{i - 1} JOIN edges ON src = node WHERE dst NOT IN ({seen}) GROUP BY 1 ORDER BY p, node LIMIT {limit}),
    l{i} AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY p, node) AS ord FROM n{i})"""
    every = " UNION ALL ".join(f"SELECT node, {i} AS depth, ord FROM l{i}" for i in range(1, depth + 1))
    return f"""{out}, r AS (SELECT node, CAST(depth AS INT) AS depth, row_number() OVER (ORDER BY depth, ord) AS ord FROM ({every}))
    SELECT node, depth, ord, (SELECT count(*) FROM r WHERE ord <= {limit}) >= {limit} AS truncated FROM r WHERE ord <= {limit}"""


@query("walk_limited", _limited_sql(1, 4, 50))
def walk_limited(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty nodes of a walk, in its order, with the truncation flag."""
    return g.walk_limited(edges(spark, d), 1, 4, 50)


_COOC = """
tok AS (SELECT DISTINCT p_brand || p_type AS file, unnest(string_split(p_name, ' ')) AS c FROM part),
co AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM tok a JOIN tok b ON a.file = b.file AND a.c < b.c GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.concat("p_brand", "p_type").alias("file"), F.explode(F.split("p_name", " ")).alias("concept"))


@query("cooccurrence", f"WITH {_COOC} SELECT * FROM co")
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Concepts that occur in two files or more together."""
    return pairs_within(_concepts(spark, d), "file", "concept", 2)


@query(
    "concept_neighborhood",
    f"""WITH RECURSIVE {_COOC}, e AS (SELECT a AS src, b AS dst FROM co WHERE n >= (SELECT avg(n) FROM co)
      UNION ALL SELECT b, a FROM co WHERE n >= (SELECT avg(n) FROM co)),
    r(node, depth) AS (SELECT 'bolt', 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 3)
    SELECT node, min(depth) AS depth FROM r GROUP BY 1 HAVING min(depth) > 0""",
)
def concept_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    """Concepts around one over links of at least mean weight."""
    co = pairs_within(_concepts(spark, d), "file", "concept", 2)
    least = co.agg(F.avg("n")).first()[0] or 0.0
    both = co.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("w"))
    both = both.unionAll(co.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("n").alias("w")))
    return g.weighted_neighborhood(both, "bolt", 3, least).select("node", "depth")


@query(
    "concept_graph",
    f"""WITH {_COOC}, deg AS (SELECT c, sum(n) AS w FROM (SELECT a AS c, n FROM co UNION ALL SELECT b, n FROM co) GROUP BY 1),
    top AS (SELECT c FROM deg ORDER BY w DESC, c LIMIT 10)
    SELECT a, b, n FROM co SEMI JOIN top x ON x.c = a SEMI JOIN top y ON y.c = b""",
)
def concept_graph(spark: SparkSession, d: str) -> DataFrame:
    """The ten heaviest concepts and the links among them."""
    co = pairs_within(_concepts(spark, d), "file", "concept", 2)
    ends = co.select(F.col("a").alias("node"), "n").unionAll(co.select(F.col("b").alias("node"), "n"))
    top = ends.groupBy("node").agg(F.sum("n").alias("w")).orderBy(F.desc("w"), "node").limit(10)
    e = co.withColumnsRenamed({"a": "src", "b": "dst"})
    return op.induced(e, top).withColumnsRenamed({"src": "a", "dst": "b"})


# -- components, cycles, layers

_CLOSURE = """
reach AS (WITH RECURSIVE r(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src)
  SELECT * FROM r),
nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
scc AS (SELECT node, least(node, coalesce(min(a.dst), node)) AS component FROM nodes
  LEFT JOIN (SELECT x.src, x.dst FROM reach x JOIN reach y ON x.src = y.dst AND x.dst = y.src) a ON a.src = node GROUP BY node)"""


@query(
    "scc",
    f"""WITH RECURSIVE {ORDER_EDGES_SQL}, {_CLOSURE}
    SELECT node, s.component, size FROM scc s JOIN (SELECT component, count(*) AS size FROM scc GROUP BY 1) z
      ON z.component = s.component""",
)
def scc(spark: SparkSession, d: str) -> DataFrame:
    """Strongly connected components, named by their least node."""
    return g.scc_layers(order_edges(spark, d)).select("node", "component", "size")


@query(
    "import_cycles",
    f"""WITH RECURSIVE {ORDER_EDGES_SQL}, {_CLOSURE} SELECT component, count(*) AS size FROM scc GROUP BY 1 HAVING count(*) > 1""",
)
def import_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of imports."""
    return g.cycles(order_edges(spark, d))


@query(
    "build_order",
    f"""WITH RECURSIVE {ORDER_EDGES_SQL}, {_CLOSURE}, ce AS (SELECT DISTINCT a.component AS x, z.component AS y FROM edges JOIN scc a ON a.node = src JOIN scc z ON z.node = dst
      WHERE a.component <> z.component),
    l(c, d) AS (SELECT component, 0 FROM scc UNION SELECT x, d + 1 FROM l JOIN ce ON y = c),
    o AS (SELECT node, s.component, size, layer FROM scc s JOIN (SELECT component, count(*) AS size FROM scc GROUP BY 1) z ON z.component = s.component
      JOIN (SELECT c, max(d) AS layer FROM l GROUP BY 1) y ON y.c = s.component)
    SELECT node, component, size, layer, CAST(row_number() OVER (ORDER BY layer, component, node) AS INT) AS step FROM o""",
)
def build_order(spark: SparkSession, d: str) -> DataFrame:
    """Build layers over components, and a step number in layer and key order."""
    x = g.scc_layers(order_edges(spark, d))
    ranked = op.dense_ids(x, ["layer", "component", "node"])
    return ranked.withColumn("step", (F.col("row") + 1).cast("int")).drop("row")


@query(
    "transitive_dependents",
    f"""WITH RECURSIVE {ORDER_EDGES_SQL}, {_CLOSURE} SELECT src AS node, count(*) AS n FROM reach WHERE src <> dst GROUP BY 1""",
)
def transitive_dependents(spark: SparkSession, d: str) -> DataFrame:
    """How many other nodes each one reaches."""
    return g.closure_counts(order_edges(spark, d))


@query(
    "class_components",
    f"""WITH RECURSIVE {ORDER_EDGES_SQL}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    r(id, component) AS (SELECT src, src FROM both_ways UNION SELECT dst, component FROM r JOIN both_ways ON src = id)
    SELECT id, min(component) AS component FROM r GROUP BY 1""",
)
def class_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the undirected graph."""
    return connected_components(order_edges(spark, d))


@query("revision_chain", """SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders""")
def revision_chain(spark: SparkSession, d: str) -> DataFrame:
    """A chain of revisions in order, found from its links alone."""
    o = op.dense_ids(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), ["id"])
    below = o.select((F.col("row") + 1).alias("row"), F.col("id").alias("parent"))
    return g.chain_order(o.join(below, "row", "left").select("id", "parent"))


@query(
    "primary_parents",
    f"""WITH {EDGES_SQL}, f AS (SELECT dst AS node, count(*) AS k FROM edges GROUP BY 1)
    SELECT dst AS node, arg_max(src, (coalesce(k, 0), -src)) AS parent FROM edges LEFT JOIN f ON f.node = src GROUP BY 1""",
)
def primary_parents(spark: SparkSession, d: str) -> DataFrame:
    """G11 (its parents alone): each node's parent in the forest."""
    return g.primary_parents(edges(spark, d))


@query(
    "module_witnesses",
    f"""WITH {EDGES_SQL} SELECT sm, dm, src, dst FROM (
      SELECT a.p_brand AS sm, b.p_brand AS dm, src, dst,
             row_number() OVER (PARTITION BY a.p_brand, b.p_brand ORDER BY src, dst) AS r
      FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand) WHERE r <= 3""",
)
def module_witnesses(spark: SparkSession, d: str) -> DataFrame:
    """Three file edges of each module edge."""
    m = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("module"))
    return g.edges_between(edges(spark, d), m, 3).select("sm", "dm", "src", "dst")


@query(
    "region_bundles",
    """SELECT a.n_regionkey AS s, b.n_regionkey AS d, count(*) AS n, round(sum(l_quantity), 3) AS demand
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
       JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = c_nationkey
       JOIN nation b ON b.n_nationkey = s_nationkey GROUP BY 1, 2""",
)
def region_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Edges and their summed demand between regions."""
    t = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier", "nation")}
    a = t["nation"].select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("s"))
    b = t["nation"].select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("d"))
    x = t["lineitem"].select("l_orderkey", "l_suppkey", "l_quantity")
    met = x.join(t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    met = met.join(t["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    met = met.join(t["supplier"].select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return (
        met.join(a, "c_nationkey")
        .join(b, "s_nationkey")
        .groupBy("s", "d")
        .agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 3).alias("demand"))
    )


def _ranks_sql(rounds: int) -> str:
    """Rounds written out one after the other."""
    out = f"""WITH {EDGES_SQL}, o AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM edges),
    v AS MATERIALIZED (SELECT src AS node FROM edges UNION SELECT dst FROM edges), t AS (SELECT count(*) AS t FROM v),
    r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / t AS rank FROM v, t)"""
    for i in range(1, rounds + 1):
        out += f""", g{i} AS MATERIALIZED (SELECT dst AS node, sum(rank / n) AS got FROM o JOIN r{i - 1} ON node = src GROUP BY 1),
    r{i} AS MATERIALIZED (SELECT v.node, 0.15 / t + 0.85 * (coalesce(got, 0) + (1 - (SELECT coalesce(sum(got), 0) FROM g{i})) / t) AS rank
      FROM v LEFT JOIN g{i} ON g{i}.node = v.node, t)"""
    return f"{out} SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query("pagerank", _ranks_sql(10))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Rank after ten rounds, to nine places."""
    return g.pagerank(edges(spark, d)).withColumn("rank", F.round("rank", 9))


# -- vectors

_DIMS = "(SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").orderBy("vec_id").first()["embedding"]


@query(
    "semantic_neighbors",
    """WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1),
    s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) AS score FROM embeddings, q)
    SELECT vec_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, vec_id LIMIT 20""",
)
def semantic_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The twenty vectors nearest to the first."""
    near = v.nearest(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), 20, "vec_id")
    return near.select("vec_id", F.round("score", 6).alias("score"))


@query(
    "concept_centroids",
    f"""WITH m AS (SELECT label, i, avg(x) AS x, count(*) AS n FROM {_DIMS} GROUP BY 1, 2),
    z AS (SELECT label, sqrt(sum(x * x)) AS z FROM m GROUP BY 1)
    SELECT m.label, n, i - 1 AS i, round(x / z, 6) AS x FROM m JOIN z ON z.label = m.label""",
)
def concept_centroids(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of each group at unit length."""
    c = v.centroids(table(spark, d, "embeddings"), "label", "embedding")
    x = c.select("label", "n", F.posexplode("centroid").alias("i", "x"))
    return x.select("label", "n", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query(
    "edge_distances",
    """WITH e AS (SELECT vec_id AS src, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS dst FROM embeddings)
    SELECT src, dst, round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
    FROM e JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst""",
)
def edge_distances(spark: SparkSession, d: str) -> DataFrame:
    """The semantic distance of each edge."""
    x = table(spark, d, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    e = x.select(F.col("vec_id").alias("src"), F.lead("vec_id").over(w).alias("dst")).where("dst IS NOT NULL")
    out = v.edge_distances(e, x, "vec_id", "embedding")
    return out.select("src", "dst", F.round("distance", 6).alias("distance"))


@query(
    "neighbourhood_profile",
    """SELECT label, count(*) AS size, round(avg(CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END), 6) AS even_share FROM embeddings GROUP BY 1""",
)
def neighbourhood_profile(spark: SparkSession, d: str) -> DataFrame:
    """Size and shares of each neighbourhood."""
    share = F.avg((F.col("vec_id") % 2 == 0).cast("int"))
    return table(spark, d, "embeddings").groupBy("label").agg(
        F.count("*").alias("size"), F.round(share, 6).alias("even_share")
    )


# -- text

_TOKENS = r"""regexp_extract_all(regexp_replace(s, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"""
_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_CANON = f"""CASE WHEN len(lower(t)) < 2 OR lower(t) IN ({_STOP}) OR regexp_full_match(t, '[0-9]+') THEN NULL
  WHEN len(t) >= 4 AND ends_with(lower(t), 's') AND NOT ends_with(lower(t), 'ss') THEN lower(t)[:-2] ELSE lower(t) END"""
_IDENT_SQL = f"""
ident AS (SELECT c_custkey AS id, replace(c_name, '#', 'HTTPRequests_') AS s FROM customer
  UNION ALL SELECT doc_id, text FROM documents),
toks AS (SELECT id, unnest({_TOKENS}) AS t FROM ident)"""


def _identifiers(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.replace("c_name", F.lit("#"), F.lit("HTTPRequests_")).alias("s")
    )
    return names.unionAll(table(spark, d, "documents").select("doc_id", "text"))


@query("identifier_tokens", f"WITH {_IDENT_SQL} SELECT t AS token, count(*) AS n FROM toks GROUP BY 1")
def identifier_tokens(spark: SparkSession, d: str) -> DataFrame:
    """tokens of all identifiers and their counts."""
    t = _identifiers(spark, d).select(F.explode(tx.split_identifier(F.col("s"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


@query(
    "concept_frequency",
    f"""WITH {_IDENT_SQL}, c AS (SELECT id, t, {_CANON} AS concept FROM toks)
    SELECT concept, count(*) AS frequency, count(DISTINCT id) AS file_count,
           array_to_string(list_sort(list(DISTINCT t)), ',') AS alt_labels FROM c WHERE concept IS NOT NULL GROUP BY 1""",
)
def concept_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Concepts with how often, in how many files, and under which forms they occur."""
    t = _identifiers(spark, d).select("id", F.explode(tx.split_identifier(F.col("s"))).alias("t"))
    forms = t.groupBy("id", "t").agg(F.count("*").alias("n"))
    concept = tx.canonical(F.col("t")).alias("concept")
    # each distinct form is made canonical once; the forms of a file serve both sides of the join
    counts = forms.groupBy("t").agg(F.sum("n").alias("n")).select(concept, "t", "n").where("concept IS NOT NULL")
    labels = F.array_join(F.array_sort(F.collect_list("t")), ",").alias("alt_labels")
    total = counts.groupBy("concept").agg(F.sum("n").alias("frequency"), labels)
    inside = forms.select("id", concept).where("concept IS NOT NULL").distinct()
    return total.join(inside.groupBy("concept").agg(F.count("*").alias("file_count")), "concept").select(
        "concept", "frequency", "file_count", "alt_labels"
    )


@query(
    "compound_frequency",
    """SELECT p_name AS compound, count(*) AS n, count(DISTINCT p_brand) AS n_files FROM part WHERE contains(p_name, ' ') GROUP BY 1""",
)
def compound_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of several tokens, grouped by their ordered tokens."""
    p = table(spark, d, "part").select("p_brand", tx.split_identifier(F.col("p_name")).alias("t"))
    c = p.where(F.size("t") > 1).groupBy("t").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("n_files"))
    return c.select(F.array_join("t", " ").alias("compound"), "n", "n_files")


@query(
    "path_parts",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS p FROM pages)
    SELECT page_id, regexp_extract(p, '[^/]*$') AS name, regexp_replace(p, '/?[^/]*$', '') AS dir,
           len(string_split(p, '/')) AS depth, sha256(p) AS sha FROM p""",
)
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Name, directory, depth and digest of each path."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("p"))
    c = F.col("p")
    return p.select(
        "page_id",
        tx.basename(c).alias("name"),
        tx.dirname(c).alias("dir"),
        F.size(F.split(c, "/")).cast("bigint").alias("depth"),
        F.sha2(c, 256).alias("sha"),
    )


@query(
    "unresolved_links",
    r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)
    SELECT CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:|^//') THEN 'external' WHEN starts_with(h, '#') THEN 'anchor'
      ELSE 'missing' END AS kind, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM h GROUP BY 1""",
)
def unresolved_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages by what becomes of them; what isn't found is counted too."""
    h = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("h"))
    kind = (
        F.when(F.col("h").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:|^//"), "external")
        .when(F.startswith("h", F.lit("#")), "anchor")
        .otherwise("missing")
    )
    return h.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


@query(
    "encoded_urls",
    """SELECT page_id, url_encode(url) AS encoded FROM pages""",
)
def encoded_urls(spark: SparkSession, d: str) -> DataFrame:
    """percent-encoded addresses."""
    return table(spark, d, "pages").select("page_id", tx.percent_encode(F.col("url")).alias("encoded"))


@query(
    "json_props",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events""",
)
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """a field of a JSON text, and times in ISO form."""
    e = table(spark, d, "events")
    k = F.from_json("props", "k bigint")["k"]
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select("event_id", k.alias("k"), iso.alias("iso"))


@query(
    "support_score",
    """SELECT p_partkey, round(ln(1 + p_size) * sqrt(p_retailprice), 6) AS score, md5(p_name) AS name_md5 FROM part""",
)
def support_score(spark: SparkSession, d: str) -> DataFrame:
    """A support score of each node."""
    score = F.log1p("p_size") * F.sqrt("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(score, 6).alias("score"), F.md5("p_name").alias("name_md5"))


@query(
    "answer_verdicts",
    r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations WHERE role = 'assistant'),
    n AS (SELECT *, greatest(1, len(list_filter(regexp_split_to_array(t, '[.!?]+(\s|$)'), lambda x: regexp_matches(x, '\S')))) AS k,
      len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS w FROM t)
    SELECT conv_id, turn, CASE WHEN t IS NULL THEN 'not_a_string' WHEN t = '' THEN 'empty' WHEN lower(t) = 'empty file' THEN NULL
      WHEN len(t) > 2000 THEN 'too_long' WHEN k > 3 THEN 'sentence_count' WHEN w > 60 THEN 'too_many_words' END AS reason FROM n""",
)
def answer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Why each generated text isn't taken."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", tx.rejection(F.lit("file_summary"), F.col("text")).alias("reason"))


# -- forests and weighted paths over the graph of orders

_SUPPORT = f"""{ORDER_EDGES_SQL},
reach AS (WITH RECURSIVE r(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src)
  SELECT * FROM r WHERE src <> dst),
nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
ins AS (SELECT dst AS node, count(*) AS i FROM edges GROUP BY 1), outs AS (SELECT src AS node, count(*) AS o FROM edges GROUP BY 1),
below AS (SELECT dst AS node, count(*) AS n FROM reach GROUP BY 1),
score AS (SELECT node, coalesce(i, 0) AS i, coalesce(o, 0) AS o,
    round(1 + 2 * ln(1 + coalesce(n, 0)) + ln(1 + coalesce(i, 0)) + 0.25 * ln(1 + coalesce(o, 0)), 9) AS support
  FROM nodes LEFT JOIN ins USING (node) LEFT JOIN outs USING (node) LEFT JOIN below USING (node)),
parent AS (SELECT src AS node, arg_max(dst, (support, i, -o, dst)) AS parent FROM edges JOIN score ON node = dst GROUP BY 1)"""


def _supports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = materialize(order_edges(spark, d))
    users = g.closure_counts(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return e, materialize(fo.support_scores(e, users))


@query("support_scores", f"WITH RECURSIVE {_SUPPORT} SELECT node, support, i AS n_in, o AS n_out FROM score")
def support_scores(spark: SparkSession, d: str) -> DataFrame:
    """How much rests on each node, from all that depend on it."""
    return _supports(spark, d)[1].select("node", "support", F.col("n_in").cast("bigint").alias("n_in"), F.col("n_out").cast("bigint").alias("n_out"))


@query(
    "import_forest",
    f"""WITH RECURSIVE {_SUPPORT},
    up AS (WITH RECURSIVE r(node, anc) AS (SELECT node, parent FROM parent UNION SELECT r.node, p.parent FROM r JOIN parent p ON p.node = r.anc) SELECT * FROM r),
    ring AS (SELECT a.node, b.node AS member FROM up a JOIN up b ON a.anc = b.node AND b.anc = a.node),
    cut AS (SELECT DISTINCT c AS node FROM (SELECT ring.node, arg_max(member, (support, i, member)) AS c FROM ring JOIN score ON score.node = member GROUP BY 1)),
    kept AS (SELECT * FROM parent ANTI JOIN cut USING (node)),
    leaf AS (SELECT node FROM nodes ANTI JOIN (SELECT parent AS node FROM kept) USING (node)),
    under AS (WITH RECURSIVE r(leaf, anc) AS (SELECT node, node FROM leaf UNION SELECT r.leaf, k.parent FROM r JOIN kept k ON k.node = r.anc) SELECT * FROM r)
    SELECT nodes.node, kept.parent, CASE WHEN cut.node IS NOT NULL THEN parent.parent END AS cut, demand
    FROM nodes JOIN (SELECT anc AS node, count(*) AS demand FROM under GROUP BY 1) USING (node)
    LEFT JOIN kept ON kept.node = nodes.node LEFT JOIN cut ON cut.node = nodes.node LEFT JOIN parent ON parent.node = nodes.node""",
)
def import_forest(spark: SparkSession, d: str) -> DataFrame:
    """Primary parents with rings cut, and the leaves that each node carries."""
    return fo.forest(*_supports(spark, d))


_WEIGHTED = f"{ORDER_EDGES_SQL}, weighted AS (SELECT src, dst, 1 + (7 * src + dst) % 9 AS w FROM edges)"
_FLOOD = f"""{_WEIGHTED},
r AS (WITH RECURSIVE x(node, distance, source) AS (SELECT k, CAST(0 AS BIGINT), k FROM ordered WHERE c % 50 = 0
    UNION SELECT dst, distance + w, source FROM x JOIN weighted ON src = node WHERE distance + w <= 25) SELECT * FROM x),
best AS (SELECT node, min((distance, source)) AS b FROM r GROUP BY 1),
flood AS (SELECT node, b[1] AS distance, b[2] AS source FROM best),
led AS (SELECT f.node, min(w.src) AS parent FROM flood f JOIN weighted w ON w.dst = f.node JOIN flood p ON p.node = w.src
  WHERE p.distance + w.w = f.distance AND p.source = f.source GROUP BY 1)"""


def _flood(spark: SparkSession, d: str) -> DataFrame:
    e = order_edges(spark, d).withColumn("w", F.expr("1 + (7 * src + dst) % 9"))
    sources = table(spark, d, "orders").where("o_custkey % 50 = 0").select(F.col("o_orderkey").alias("node"))
    return pa.shortest_paths(e, sources, limit=25)


@query("impact_flood", f"WITH RECURSIVE {_FLOOD} SELECT node, distance, source, parent FROM flood LEFT JOIN led USING (node)")
def impact_flood(spark: SparkSession, d: str) -> DataFrame:
    """What changes of some nodes flood, by weighted distance, each node with its source and the node that it came by."""
    return _flood(spark, d)


@query(
    "impact_traces",
    f"""WITH RECURSIVE {_FLOOD},
    way AS (WITH RECURSIVE x(node, path) AS (SELECT node, CAST(node AS VARCHAR) FROM flood WHERE distance = 0
      UNION ALL SELECT led.node, path || '>' || led.node FROM x JOIN led ON led.parent = x.node) SELECT * FROM x)
    SELECT way.node, path FROM way JOIN flood USING (node) WHERE distance >= 15""",
)
def impact_traces(spark: SparkSession, d: str) -> DataFrame:
    """The way of a change to the nodes that are 15 away or more."""
    found = materialize(_flood(spark, d))
    return pa.traced(found, found.where("distance >= 15")).select("node", F.array_join("path", ">").alias("path"))


# -- communities, brokers, neighbourhoods


def _communities_sql(rounds: int) -> str:
    out = f"""WITH {ORDER_EDGES_SQL}, links AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    c0 AS (SELECT DISTINCT src AS node, src AS community FROM links)"""
    for i in range(1, rounds + 1):
        out += f""", c{i} AS MATERIALIZED (SELECT src AS node, arg_min(community, (-n, community)) AS community FROM (
      SELECT src, community, count(*) AS n FROM links JOIN c{i - 1} ON node = dst GROUP BY 1, 2) GROUP BY 1)"""
    return f"{out} SELECT node, community FROM c{rounds}"


@query("communities", _communities_sql(6))
def communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities after six rounds of label propagation."""
    return cm.communities(order_edges(spark, d), 6)


@query(
    "co_changes",
    """WITH c AS (SELECT DISTINCT l_suppkey AS g, l_orderkey AS o FROM lineitem), own AS (SELECT g, count(*) AS n FROM c GROUP BY 1),
    t AS (SELECT count(DISTINCT o) AS t FROM c),
    m AS (SELECT a.g AS a, b.g AS b, count(*) AS n FROM c a JOIN c b ON a.o = b.o AND a.g < b.g GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT a, b, m.n, round(m.n * t / (x.n * y.n), 9) AS lift FROM m JOIN own x ON x.g = a JOIN own y ON y.g = b, t""",
)
def co_changes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that stand in three orders or more together, and by how much more than by chance."""
    found = cm.co_changes(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", 3)
    return found.withColumn("lift", F.round("lift", 9))


@query("betweenness")
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    """How many shortest paths lead through each order, exactly: all of them are sources."""
    e = materialize(order_edges(spark, d))
    found = cm.betweenness(e, e.select(F.col("src").alias("node")).distinct())
    return found.withColumn("score", F.round("score", 9))


def _kmeans_sql(k: int, rounds: int) -> str:
    away = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    out = f"""WITH x AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS c, v FROM x ORDER BY vec_id LIMIT {k})"""
    for i in range(rounds + 1):
        out += f""", a{i} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, any_value(xv) AS v, min((d, c)) AS m
      FROM (SELECT x.vec_id, x.label, x.v AS xv, c.c, {away} AS d FROM x, c{i} c) GROUP BY 1)"""
        if i < rounds:
            out += f""", c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(t.v, o.v) AS v FROM c{i} o LEFT JOIN (
        SELECT c, list(e ORDER BY i) AS v FROM (SELECT m[2] AS c, i, avg(v[i]) AS e FROM a{i}, unnest(range(1, len(v) + 1)) AS u(i) GROUP BY 1, 2) GROUP BY 1) t ON t.c = o.c)"""
    return f"""{out}, g AS (SELECT m[2] AS cluster, label, count(*) AS n, count(*) FILTER (vec_id % 2 = 0) AS e FROM a{rounds} GROUP BY 1, 2)
    SELECT CAST(cluster AS INT) AS cluster, CAST(sum(n) AS BIGINT) AS n, arg_max(label, (n, -label)) AS dominant, round(max(n) / sum(n), 9) AS purity, round(sum(e) / sum(n), 9) AS share
    FROM g GROUP BY cluster"""


@query("neighbourhood_census", _kmeans_sql(12, 10))
def neighbourhood_census(spark: SparkSession, d: str) -> DataFrame:
    """Twelve neighbourhoods by k-means, ten rounds from a stated start, with their dominant group and its share."""
    e = table(spark, d, "embeddings")
    found = v.kmeans(e, "vec_id", "embedding", 12, 10).join(e.select("vec_id", "label"), "vec_id")
    out = v.census(found, "label", "vec_id % 2 = 0")
    return out.withColumns({c: F.round(c, 9) for c in ("purity", "share")})
