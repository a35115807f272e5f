"""Queries of the relational operators: degrees, roll-ups, ranking, joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import relational as op
from graphloom.operators.setjoin import jaccard_pairs
from graphloom.plans.registry import query
from graphloom.plans.tables import ALL_EDGES_SQL, EDGES_SQL, all_edges, edges, files, table

_DEG_SQL = """
deg AS (SELECT node, sum(i) AS n_in, sum(o) AS n_out, sum(i + o) AS total FROM (
  SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node)"""


@query(
    "central_files",
    f"""WITH {EDGES_SQL}, {_DEG_SQL}
    SELECT node, CAST(n_in AS BIGINT) AS n_in, CAST(n_out AS BIGINT) AS n_out, CAST(total AS BIGINT) AS total, p_name
    FROM deg JOIN part ON p_partkey = node ORDER BY total DESC, node LIMIT 20""",
)
def central_files(spark: SparkSession, d: str) -> DataFrame:
    """The twenty nodes with most edges, with their names."""
    names = table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_name")
    return op.degrees(edges(spark, d)).join(names, "node").orderBy(F.desc("total"), "node").limit(20)


@query(
    "degree_by_kind",
    """SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, CAST(count(*) AS BIGINT) AS total FROM (
      SELECT l_partkey AS node, 0 AS i, 1 AS o FROM lineitem WHERE l_returnflag = 'R'
      UNION ALL SELECT l_suppkey, 1, 0 FROM lineitem WHERE l_returnflag = 'R') GROUP BY node""",
)
def degree_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Degrees over the references of one kind."""
    x = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R")
    return op.degrees(x.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query(
    "files_by_language",
    "SELECT coalesce(lang, '(none)') AS language, count(*) AS n FROM documents GROUP BY 1",
)
def files_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Files of each language, most first."""
    f = files(spark, d).groupBy(F.coalesce("language", F.lit("(none)")).alias("language")).agg(F.count("*").alias("n"))
    return f.orderBy(F.desc("n"), "language")


_MODULES = "(SELECT p_partkey AS node, p_brand AS module FROM part)"
_ROLL_SQL = f"""
rolled AS (SELECT s.module AS sm, t.module AS dm, count(*) AS weight
  FROM edges JOIN {_MODULES} s ON src = s.node JOIN {_MODULES} t ON dst = t.node WHERE s.module <> t.module GROUP BY 1, 2)"""


def _modules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("module"))


@query("module_edges", f"WITH {EDGES_SQL}, {_ROLL_SQL} SELECT * FROM rolled")
def module_edges(spark: SparkSession, d: str) -> DataFrame:
    """File edges counted between modules."""
    return op.module_edges(edges(spark, d), _modules(spark, d))


@query(
    "module_instability",
    f"""WITH {EDGES_SQL}, {_ROLL_SQL},
    o AS (SELECT sm AS module, count(DISTINCT dm) AS ce FROM rolled GROUP BY 1),
    i AS (SELECT dm AS module, count(DISTINCT sm) AS ca FROM rolled GROUP BY 1)
    SELECT coalesce(o.module, i.module) AS module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce,
           round(coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)), 3) AS instability
    FROM o FULL JOIN i ON o.module = i.module""",
)
def module_instability(spark: SparkSession, d: str) -> DataFrame:
    """Coupling of each module and its instability."""
    return op.coupling(op.module_edges(edges(spark, d), _modules(spark, d)))


@query(
    "module_risk",
    f"""WITH {EDGES_SQL}, {_ROLL_SQL},
    o AS (SELECT sm AS module, count(DISTINCT dm) AS ce FROM rolled GROUP BY 1),
    i AS (SELECT dm AS module, count(DISTINCT sm) AS ca FROM rolled GROUP BY 1),
    c AS (SELECT coalesce(o.module, i.module) AS module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce
          FROM o FULL JOIN i ON o.module = i.module),
    m AS (SELECT module, ca, ce, ca >= 6 AND ce >= 6 AS god, ca >= 3 AND ce > ca AS shaky FROM c)
    SELECT module, CASE WHEN god THEN 'high' WHEN shaky THEN 'elevated' ELSE 'low' END AS risk,
           concat_ws('; ', CASE WHEN god THEN 'god-module: high fan-in and high fan-out' END,
                     CASE WHEN shaky THEN 'high fan-in on an unstable component' END) AS reasons,
           CASE WHEN ca >= 3 AND ce <= greatest(1, ca // 3) THEN 'reusable' WHEN ca = 0 THEN 'replaceable'
                ELSE 'internal' END AS reusability FROM m""",
)
def module_risk(spark: SparkSession, d: str) -> DataFrame:
    """Risk level with its reasons, and how reusable a module is, from its coupling."""
    c = op.coupling(op.module_edges(edges(spark, d), _modules(spark, d)))
    god, shaky = (F.col("ca") >= 6) & (F.col("ce") >= 6), (F.col("ca") >= 3) & (F.col("ce") > F.col("ca"))
    reasons = F.array_compact(
        F.array(
            F.when(god, "god-module: high fan-in and high fan-out"),
            F.when(shaky, "high fan-in on an unstable component"),
        )
    )
    reuse = F.when((F.col("ca") >= 3) & (F.col("ce") <= F.greatest(F.lit(1), F.floor(F.col("ca") / 3))), "reusable")
    return c.select(
        "module",
        F.when(god, "high").when(shaky, "elevated").otherwise("low").alias("risk"),
        F.array_join(reasons, "; ").alias("reasons"),
        reuse.when(F.col("ca") == 0, "replaceable").otherwise("internal").alias("reusability"),
    )


@query(
    "relationship_strength",
    """SELECT l_returnflag AS kind, p_brand AS sm, s_nationkey AS dm, count(*) AS strength,
              bool_and(l_linestatus = 'F') AS exact
       FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""",
)
def relationship_strength(spark: SparkSession, d: str) -> DataFrame:
    """References between modules by kind; a relationship is as sure as its weakest link."""
    x = table(spark, d, "lineitem")
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    met = x.join(p, x.l_partkey == p.p_partkey).join(s, x.l_suppkey == s.s_suppkey)
    return met.groupBy(
        F.col("l_returnflag").alias("kind"), F.col("p_brand").alias("sm"), F.col("s_nationkey").alias("dm")
    ).agg(F.count("*").alias("strength"), F.bool_and(F.col("l_linestatus") == "F").alias("exact"))


@query(
    "coverage_rollup",
    """SELECT coalesce(d.lang, '(total)') AS language, count(*) AS n_files, count(l.doc_id) AS n_labelled,
              count(*) FILTER (l.quality = 1) AS n_good, CAST(sum(n_chars) AS BIGINT) AS n_chars
       FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON d.doc_id = l.doc_id
       GROUP BY ROLLUP (d.lang)""",
)
def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by language and in total, in one pass."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, d, "labels").select("doc_id", "quality").distinct().withColumn("has", F.lit(1))
    return (
        docs.join(labels, "doc_id", "left")
        .rollup("lang")
        .agg(
            F.count("*").alias("n_files"),
            F.count("has").alias("n_labelled"),
            F.count_if(F.col("quality") == 1).alias("n_good"),
            F.sum("n_chars").alias("n_chars"),
        )
        .withColumn("lang", F.coalesce("lang", F.lit("(total)")))
        .withColumnRenamed("lang", "language")
    )


@query(
    "xref_grouping_sets",
    """SELECT l_returnflag AS kind, l_linestatus AS resolution, count(*) AS n FROM lineitem
       GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""",
)
def xref_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Counts by kind, by resolution and overall."""
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("resolution"))
    sets = [[F.col("kind")], [F.col("resolution")], []]
    return x.groupingSets(sets, "kind", "resolution").agg(F.count("*").alias("n"))


@query(
    "predicate_counts",
    """SELECT event_type AS p, split_part(event_type, 'i', 1) AS ns, count(*) AS n, count(DISTINCT user_id) AS n_subjects
       FROM events GROUP BY ALL""",
)
def predicate_counts(spark: SparkSession, d: str) -> DataFrame:
    """Triples of each predicate, with its namespace."""
    e = table(spark, d, "events")
    return e.groupBy(
        F.col("event_type").alias("p"), F.split_part(F.col("event_type"), F.lit("i"), F.lit(1)).alias("ns")
    ).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_subjects"))


_FLOORS = [0, 1, 2, 3, 5, 9, 17, 33]
_CASE = " ".join(f"WHEN t >= {f} THEN {f}" for f in reversed(_FLOORS))


@query(
    "degree_histogram",
    f"""WITH {EDGES_SQL}, {_DEG_SQL}, pop AS (SELECT coalesce(total, 0) AS t FROM part LEFT JOIN deg ON node = p_partkey)
    SELECT CASE {_CASE} END AS floor, count(*) AS n FROM pop GROUP BY 1""",
)
def degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    """All nodes by degree, those without edges too."""
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    t = nodes.join(op.degrees(edges(spark, d)), "node", "left").withColumn("t", F.coalesce("total", F.lit(0)))
    return op.histogram(t, F.col("t"), _FLOORS)


_SIZES = [0, 256, 1024, 4096, 16384, 65536]


@query(
    "inventory_fold",
    f"""SELECT count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(DISTINCT source) AS n_modules,
        CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines, max(n_chars) AS longest,
        {", ".join(f"count(*) FILTER (n_chars >= {a}" + (f" AND n_chars < {b}" if b else "") + f") AS from_{a}"
                   for a, b in zip(_SIZES, [*_SIZES[1:], None]))}
        FROM documents""",
)
def inventory_fold(spark: SparkSession, d: str) -> DataFrame:
    """Counts, totals and a size histogram of all files in one pass."""
    n = F.col("n_chars")
    sizes = [
        F.count_if((n >= a) & (n < b) if b else n >= a).alias(f"from_{a}") for a, b in zip(_SIZES, [*_SIZES[1:], None])
    ]
    return table(spark, d, "documents").agg(
        F.count("*").alias("n_files"),
        F.sum(n).alias("n_chars"),
        F.count_distinct("source").alias("n_modules"),
        F.sum(F.size(F.split("text", "\n", -1))).alias("n_lines"),
        F.max(n).alias("longest"),
        *sizes,
    )


@query(
    "enrichment_buckets",
    """WITH c AS (SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    spine AS (SELECT event_type, unnest(generate_series(min(bucket), max(bucket), INTERVAL 10 MINUTES)) AS bucket
              FROM c GROUP BY 1)
    SELECT epoch(s.bucket)::BIGINT AS bucket_s, s.event_type, coalesce(n, 0) AS n
    FROM spine s LEFT JOIN c ON c.bucket = s.bucket AND c.event_type = s.event_type""",
)
def enrichment_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Ten-minute buckets of each kind, gaps filled with zeros."""
    b = op.time_buckets(table(spark, d, "events"), "ts", 10, "event_type")
    return b.select(F.unix_timestamp("bucket").alias("bucket_s"), "event_type", "n")


@query(
    "top_files_per_module",
    """SELECT source AS module, doc_id, n_chars AS size, CAST(r AS INTEGER) AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents)
       WHERE r <= 5""",
)
def top_files_per_module(spark: SparkSession, d: str) -> DataFrame:
    """The five largest files of each module."""
    f = files(spark, d).select("module", "doc_id", "size")
    return op.top_per_group(f, ["module"], [F.desc("size"), F.asc("doc_id")], 5)


@query(
    "file_page",
    """SELECT doc_id, n_chars AS size, (SELECT count(*) FROM documents WHERE lang = 'en') AS total,
              (SELECT count(*) FROM documents WHERE lang = 'en') > 30 AS truncated
       FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10""",
)
def file_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the files of one language, with the total."""
    f = files(spark, d).where(F.col("language") == "en").select("doc_id", "size")
    return op.page(f, [F.desc("size"), F.asc("doc_id")], 20, 10)


@query(
    "lexical_search",
    """WITH s AS (SELECT p_partkey AS idx, CASE WHEN contains(lower(p_name), 'small') THEN 1.0::DOUBLE
                  WHEN contains(lower(p_type), 'small') THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS score FROM part)
       SELECT idx, score FROM s WHERE score > 0 ORDER BY score DESC, idx LIMIT 25""",
)
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    """1.0 for a hit in the name, 0.5 in the type."""
    hit = lambda c: F.contains(F.lower(c), F.lit("small"))
    score = F.when(hit("p_name"), 1.0).when(hit("p_type"), 0.5).otherwise(0.0)
    s = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), score.alias("score"))
    return s.where("score > 0").orderBy(F.desc("score"), "idx").limit(25)


@query(
    "token_search",
    """WITH r AS (SELECT c_custkey AS id, lower(c_name) AS t, lower(c_mktsegment) AS sub FROM customer),
    s AS (SELECT id, t, list_sum(list_transform(['cust', '1'], lambda q: CASE WHEN t = q THEN 100 WHEN starts_with(t, q)
            THEN 50 WHEN starts_with(sub, q) THEN 25 ELSE 15 END)) AS score
          FROM r WHERE (contains(t, 'cust') OR contains(sub, 'cust')) AND (contains(t, '1') OR contains(sub, '1')))
    SELECT id, CAST(score AS INTEGER) AS score FROM s ORDER BY score DESC, t, id LIMIT 14""",
)
def token_search(spark: SparkSession, d: str) -> DataFrame:
    """Every token must occur; exact, prefix, subtitle prefix and inner hits score less in turn."""
    tokens = ["cust", "1"]
    r = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.lower("c_name").alias("t"), F.lower("c_mktsegment").alias("sub")
    )
    has, score = F.lit(True), F.lit(0)
    for q in tokens:
        has = has & (F.contains("t", F.lit(q)) | F.contains("sub", F.lit(q)))
        score = score + F.when(F.col("t") == q, 100).when(F.startswith("t", F.lit(q)), 50).when(
            F.startswith("sub", F.lit(q)), 25
        ).otherwise(15)
    found = r.where(has).select("id", "t", score.alias("score"))
    return found.orderBy(F.desc("score"), "t", "id").limit(14).select("id", "score")


@query(
    "items_by_attribute",
    """SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: contains(x, 'tion'))) AS n FROM documents
       WHERE len(list_filter(string_split(text, ' '), lambda x: contains(x, 'tion'))) > 0""",
)
def items_by_attribute(spark: SparkSession, d: str) -> DataFrame:
    """Items with an attribute that holds the pattern."""
    attrs = F.split("text", " ", -1)
    has = F.filter(attrs, lambda x: F.contains(x, F.lit("tion")))
    return (
        table(spark, d, "documents")
        .where(F.contains("text", F.lit("tion")))
        .select("doc_id", F.size(has).cast("bigint").alias("n"))
        .where("n > 0")
    )


@query(
    "file_graph",
    f"""WITH {EDGES_SQL}, {_DEG_SQL}, top AS (SELECT node FROM deg ORDER BY total DESC, node LIMIT 200)
    SELECT src, dst FROM edges SEMI JOIN top a ON src = a.node SEMI JOIN top b ON dst = b.node""",
)
def file_graph(spark: SparkSession, d: str) -> DataFrame:
    """The edges among the two hundred most connected nodes."""
    e = edges(spark, d)
    return op.induced(e, op.degrees(e).orderBy(F.desc("total"), "node").limit(200).select("node"))


@query(
    "role_rows",
    """WITH r AS (SELECT p_partkey, p_type, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank,
                  row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS kr FROM part)
       SELECT p_partkey, p_type FROM r WHERE rank <= 40 OR kr <= 5""",
)
def role_rows(spark: SparkSession, d: str) -> DataFrame:
    """The forty first rows, and five of every kind."""
    order = [F.desc("p_retailprice"), F.asc("p_partkey")]
    return op.capped_with_floor(table(spark, d, "part"), "p_type", order, 40, 5).select("p_partkey", "p_type")


@query(
    "dense_rows",
    """SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_type, p_name, p_partkey) - 1 AS row FROM part""",
)
def dense_rows(spark: SparkSession, d: str) -> DataFrame:
    """Dense row numbers in a total order, counted by partitions."""
    p = table(spark, d, "part").select("p_brand", "p_type", "p_name", "p_partkey")
    return op.dense_ids(p, ["p_brand", "p_type", "p_name", "p_partkey"]).select("p_partkey", "row")


@query(
    "first_owner",
    """SELECT l_partkey, l_orderkey, CASE WHEN r = 1 THEN 'creates' ELSE 'modifies' END AS action FROM (
         SELECT DISTINCT l_partkey, l_orderkey,
                dense_rank() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS r FROM lineitem)""",
)
def first_owner(spark: SparkSession, d: str) -> DataFrame:
    """The first step that touches a file creates it, later ones modify it."""
    x = table(spark, d, "lineitem").select("l_partkey", "l_orderkey").distinct()
    r = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey"))
    return x.select("l_partkey", "l_orderkey", F.when(r == 1, "creates").otherwise("modifies").alias("action"))


@query(
    "keep_first_chunk",
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (
         PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""",
)
def keep_first_chunk(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each key."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return op.keep_first(e, ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).drop("ts")


@query(
    "test_subject",
    """WITH s AS (SELECT l_partkey AS test, l_suppkey AS subject, CAST(sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY 1, 2),
    m AS (SELECT test, max(score) AS top FROM s GROUP BY 1)
    SELECT s.test, any_value(subject) AS subject, top AS score FROM s JOIN m ON s.test = m.test AND score = top
    GROUP BY s.test, top HAVING count(*) = 1""",
)
def test_subject(spark: SparkSession, d: str) -> DataFrame:
    """A test's subject is the best scored one; ties name none."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("test"), F.col("l_suppkey").alias("subject"))
    return op.strict_argmax(s.agg(F.sum("l_quantity").cast("bigint").alias("score")), ["test"], "score")


@query(
    "module_index",
    """SELECT p_brand || '.' || p_type || '.' || p_name AS module, min(p_partkey) AS p_partkey FROM part GROUP BY 1
       HAVING count(DISTINCT p_partkey) = 1""",
)
def module_index(spark: SparkSession, d: str) -> DataFrame:
    """Index keys with exactly one target; ambiguous ones are dropped."""
    name = F.concat_ws(".", "p_brand", "p_type", "p_name").alias("module")
    return op.unambiguous(table(spark, d, "part").select(name, "p_partkey"), "module", "p_partkey")


@query(
    "strongest_edge",
    f"""WITH {ALL_EDGES_SQL} SELECT src, dst, max(w) AS w FROM all_edges GROUP BY 1, 2""",
)
def strongest_edge(spark: SparkSession, d: str) -> DataFrame:
    """Each edge once, at its greatest strength."""
    return all_edges(spark, d).groupBy("src", "dst").agg(F.max("w").alias("w"))


@query(
    "dead_code",
    f"""WITH {ALL_EDGES_SQL} SELECT p_partkey, p_size >= 25 AS sure FROM part
    WHERE NOT EXISTS (SELECT 1 FROM all_edges WHERE dst = p_partkey AND w = 50) AND p_type NOT LIKE 'STANDARD%'""",
)
def dead_code(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that nothing imports at full weight and that aren't entry points."""
    used = all_edges(spark, d).where("w = 50").select(F.col("dst").alias("p_partkey")).distinct()
    p = table(spark, d, "part").where(~F.startswith("p_type", F.lit("STANDARD")))
    return p.join(used, "p_partkey", "left_anti").select("p_partkey", (F.col("p_size") >= 25).alias("sure"))


@query(
    "test_gaps",
    """SELECT source AS module, count(*) AS n_files, count(l.doc_id) AS n_covered FROM documents d
       LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1""",
)
def test_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Files of each module and those with a test."""
    covered = table(spark, d, "labels").select("doc_id").distinct().withColumn("c", F.lit(1))
    f = files(spark, d).join(covered, "doc_id", "left")
    return f.groupBy("module").agg(F.count("*").alias("n_files"), F.count("c").alias("n_covered"))


@query(
    "untested_files",
    "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def untested_files(spark: SparkSession, d: str) -> DataFrame:
    """Files without a test."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query(
    "declared_externals",
    """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')""",
)
def declared_externals(spark: SparkSession, d: str) -> DataFrame:
    """External imports that a manifest declares."""
    o = table(spark, d, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query(
    "orphan_edges",
    """SELECT l_orderkey, l_linenumber FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey
       UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem ANTI JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0""",
)
def orphan_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose target doesn't exist."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    o, s = table(spark, d, "orders"), table(spark, d, "supplier").where("s_acctbal > 0")
    a = x.join(o, x.l_orderkey == o.o_orderkey, "left_anti")
    return a.unionAll(x.join(s, x.l_suppkey == s.s_suppkey, "left_anti")).select("l_orderkey", "l_linenumber")


@query(
    "chunk_file_join",
    """SELECT e.event_id, e.user_id, c_name FROM events e LEFT JOIN customer ON c_custkey = e.user_id * 7""",
)
def chunk_file_join(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their file, null where it is missing."""
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("user_id") * 7).alias("k"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return e.join(c, "k", "left").drop("k")


@query(
    "priority_lookup",
    """WITH cand AS (SELECT p_brand || '.' || p_name AS key, p_partkey AS target, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 30 THEN 1 ELSE 2 END AS prio FROM part),
    best AS (SELECT key, min(prio) AS prio FROM cand GROUP BY 1)
    SELECT c.key, min(target) AS target, c.prio FROM cand c JOIN best b ON b.key = c.key AND b.prio = c.prio
    GROUP BY c.key, c.prio HAVING count(DISTINCT target) = 1""",
)
def priority_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The candidate of the best priority, none if that is ambiguous."""
    p = table(spark, d, "part")
    prio = F.when(F.col("p_size") <= 10, 0).when(F.col("p_size") <= 30, 1).otherwise(2)
    cand = p.select(F.concat_ws(".", "p_brand", "p_name").alias("key"), F.col("p_partkey").alias("target"), prio.alias("prio"))
    return op.priority_lookup(cand.select("key").distinct(), cand, "key", "target", "prio")


_PATHS = "(SELECT doc_id, source || '/' || lang || '/d' || CAST(doc_id // 3 AS VARCHAR) || '.txt' AS path FROM documents)"
_SPECS = "(SELECT DISTINCT lang || '/d' || CAST(doc_id // 3 AS VARCHAR) || '.txt' AS spec FROM documents)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor(F.col("doc_id") / 3).cast("string")
    x = table(spark, d, "documents")
    return x.select(
        "doc_id",
        F.concat("source", F.lit("/"), "lang", F.lit("/d"), n, F.lit(".txt")).alias("path"),
        F.concat("lang", F.lit("/d"), n, F.lit(".txt")).alias("spec"),
    )


@query(
    "suffix_join",
    f"""WITH p AS (SELECT DISTINCT path FROM {_PATHS}),
    m AS (SELECT spec, path, count(*) OVER (PARTITION BY spec) AS n, row_number() OVER (PARTITION BY spec ORDER BY path) AS r
          FROM {_SPECS} JOIN p ON regexp_extract(path, '[^/]*$') = regexp_extract(spec, '[^/]*$')
               AND ends_with(path, '/' || spec))
    SELECT spec, path, n, n = 1 AS resolved FROM m WHERE r <= 16""",
)
def suffix_join(spark: SparkSession, d: str) -> DataFrame:
    """Paths that end in a spec, met on their last segment."""
    p = _paths(spark, d)
    return op.suffix_join(p, p, "spec", "path")


@query(
    "longest_prefix",
    f"""WITH p AS (SELECT DISTINCT path FROM {_PATHS}),
    owners AS (SELECT DISTINCT source AS root FROM documents UNION SELECT DISTINCT source || '/' || lang FROM documents WHERE lang <> 'en')
    SELECT path, max_by(root, len(root)) AS root FROM p JOIN owners ON starts_with(path, root || '/') GROUP BY path""",
)
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The deepest owner directory of each path."""
    x = table(spark, d, "documents")
    owners = x.select(F.col("source").alias("root")).unionAll(
        x.where("lang <> 'en'").select(F.concat("source", F.lit("/"), "lang").alias("root"))
    )
    return op.longest_prefix_join(_paths(spark, d).select("path").distinct(), owners, "path", "root")


@query(
    "containment_join",
    """WITH s AS (SELECT user_id, event_id AS id, epoch(ts)::BIGINT AS a, epoch(ts)::BIGINT + CAST(value AS BIGINT) * 600 AS b FROM events)
    SELECT i.user_id, i.id, arg_min(o.id, (o.b - o.a, o.a, o.id)) AS outer_id FROM s i JOIN s o ON i.user_id = o.user_id
      AND o.a <= i.a AND i.b <= o.b AND (o.a < i.a OR i.b < o.b) GROUP BY 1, 2""",
)
def containment_join(spark: SparkSession, d: str) -> DataFrame:
    """Each span with the tightest span of its key around it; seconds and values to the nearest whole, halves to the even one."""
    a = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("bigint")
    s = table(spark, d, "events").select(
        "user_id", F.col("event_id").alias("id"), a.alias("a"), (a + F.rint("value").cast("bigint") * 600).alias("b")
    )
    return op.containment_join(s, s, ["user_id"])


@query(
    "mutual_imports",
    f"""WITH {ALL_EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM all_edges)
    SELECT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst""",
)
def mutual_imports(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that import each other."""
    return op.mutual(all_edges(spark, d).select("src", "dst").distinct())


@query(
    "duplicated_responsibilities",
    """WITH s AS (SELECT DISTINCT o_custkey AS g, o_orderpriority || o_orderstatus AS i FROM orders),
    z AS (SELECT g, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 5),
    m AS (SELECT a.g AS a, b.g AS b, count(*) AS k FROM s a JOIN s b ON a.i = b.i AND a.g < b.g SEMI JOIN z ON z.g = a.g GROUP BY 1, 2)
    SELECT m.a, m.b, round(k / (x.n + y.n - k), 6) AS jaccard FROM m JOIN z x ON x.g = m.a JOIN z y ON y.g = m.b
    WHERE k / (x.n + y.n - k) >= 0.85""",
)
def duplicated_responsibilities(spark: SparkSession, d: str) -> DataFrame:
    """Modules whose sets of concepts are alike."""
    o = table(spark, d, "orders").select("o_custkey", F.concat("o_orderpriority", "o_orderstatus").alias("c"))
    return jaccard_pairs(o, "o_custkey", "c", 0.85, 5).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "inheritance_forest",
    """WITH n AS (SELECT s_nationkey, min(s_suppkey) AS base FROM supplier GROUP BY 1 HAVING count(*) = 1)
    SELECT c_custkey, base FROM customer JOIN n ON c_nationkey = s_nationkey
    UNION ALL SELECT c_custkey, NULL FROM customer ANTI JOIN n ON c_nationkey = s_nationkey""",
)
def inheritance_forest(spark: SparkSession, d: str) -> DataFrame:
    """A class's base where its name is unique, null elsewhere."""
    n = op.unambiguous(table(spark, d, "supplier"), "s_nationkey", "s_suppkey").withColumnsRenamed(
        {"s_nationkey": "c_nationkey", "s_suppkey": "base"}
    )
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, "c_nationkey", "left").drop("c_nationkey")


@query(
    "interface_symbols",
    """SELECT p_partkey, p_name, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50) AS interface FROM part""",
)
def interface_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols with a flag for those used from outside."""
    used = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct()
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return p.join(used.withColumn("u", F.lit(True)), "p_partkey", "left").select(
        "p_partkey", "p_name", F.coalesce("u", F.lit(False)).alias("interface")
    )


@query(
    "anchor_vote",
    """WITH m AS (SELECT p_brand, p_partkey, sum(l_quantity) AS mass, count(DISTINCT l_suppkey) AS n_foreign
                  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
    SELECT p_brand, arg_max(p_partkey, (mass, -p_partkey)) AS anchor, CAST(max(mass) AS DOUBLE) AS mass,
           count(*) FILTER (n_foreign >= 2) AS interchanges FROM m GROUP BY 1""",
)
def anchor_vote(spark: SparkSession, d: str) -> DataFrame:
    """The heaviest file of each subsystem, and how many serve several others."""
    x, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_brand")
    m = x.join(p, x.l_partkey == p.p_partkey).groupBy("p_brand", "p_partkey")
    m = m.agg(F.sum("l_quantity").alias("mass"), F.count_distinct("l_suppkey").alias("n_foreign"))
    return m.groupBy("p_brand").agg(
        F.max_by("p_partkey", F.struct("mass", -F.col("p_partkey"))).alias("anchor"),
        F.max("mass").alias("mass"),
        F.count_if(F.col("n_foreign") >= 2).alias("interchanges"),
    )


@query(
    "asset_census",
    """SELECT p_type AS kind, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY 1""",
)
def asset_census(spark: SparkSession, d: str) -> DataFrame:
    """Number and bytes of each kind of asset."""
    return table(spark, d, "part").groupBy(F.col("p_type").alias("kind")).agg(
        F.count("*").alias("n"), F.sum("p_size").alias("bytes")
    )


@query(
    "asset_gallery",
    """SELECT kind, id, size, omitted FROM (SELECT p_brand AS kind, p_partkey AS id, p_size AS size,
         row_number() OVER w AS r, sum(p_size) OVER w AS s, count(*) OVER (PARTITION BY p_brand) AS n FROM part
         WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS UNBOUNDED PRECEDING)) x
       JOIN (SELECT p_brand AS k, count(*) FILTER (r > 12 OR s > 100) AS omitted FROM (SELECT p_brand,
         row_number() OVER v AS r, sum(p_size) OVER v AS s FROM part
         WINDOW v AS (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS UNBOUNDED PRECEDING)) GROUP BY 1) ON k = kind
       WHERE r <= 12 AND s <= 100""",
)
def asset_gallery(spark: SparkSession, d: str) -> DataFrame:
    """The smallest assets of each kind within a count and a byte cap, and how many were left out."""
    w = Window.partitionBy("kind").orderBy("size", "id").rowsBetween(Window.unboundedPreceding, 0)
    p = table(spark, d, "part").select(
        F.col("p_brand").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_size").alias("size")
    )
    x = p.withColumn("fits", (F.row_number().over(w) <= 12) & (F.sum("size").over(w) <= 100))
    omitted = F.count_if(~F.col("fits")).over(Window.partitionBy("kind"))
    return x.withColumn("omitted", omitted).where("fits").drop("fits")


@query(
    "component_rollup",
    f"""SELECT array_to_string(string_split(path, '/')[1:2], '/') AS component, count(*) AS n FROM {_PATHS} GROUP BY 1""",
)
def component_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Files of each path prefix of two segments."""
    return op.component_rollup(_paths(spark, d), "path", 2)


@query(
    "model_bench",
    """SELECT event_type AS model, count(*) AS n, round(median(value), 6) AS median, round(avg(value), 6) AS mean FROM events GROUP BY 1""",
)
def model_bench(spark: SparkSession, d: str) -> DataFrame:
    """Median and mean of each model."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(
        F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median"), F.round(F.avg("value"), 6).alias("mean")
    )


@query(
    "symbols_per_part",
    """SELECT p_brand AS part, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n,
              count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def symbols_per_part(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each kind as columns."""
    x, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("part"))
    met = x.join(p, x.l_partkey == p.p_partkey)
    out = met.groupBy("part").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return out.select("part", *(F.coalesce(k, F.lit(0)).alias(k.lower()) for k in "ANR"))


@query(
    "dependency_concentration",
    """SELECT l_suppkey AS package, count(DISTINCT p_brand) AS n_modules, count(DISTINCT p_brand) >= 8 AS elevated
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def dependency_concentration(spark: SparkSession, d: str) -> DataFrame:
    """Modules that import each package."""
    x, p = table(spark, d, "lineitem").select("l_partkey", "l_suppkey"), table(spark, d, "part")
    n = x.join(p, x.l_partkey == p.p_partkey).groupBy(F.col("l_suppkey").alias("package"))
    n = n.agg(F.count_distinct("p_brand").alias("n_modules"))
    return n.withColumn("elevated", F.col("n_modules") >= 8)


@query(
    "package_table",
    """SELECT source AS package, count(*) AS n_files, arg_max(lang, (k, -code)) AS dominant, sum(k) AS checked FROM (
         SELECT source, lang, count(*) AS k, unicode(lang) * 256 + unicode(lang[2]) AS code FROM documents GROUP BY source, lang)
       GROUP BY 1""".replace("count(*) AS n_files", "CAST(sum(k) AS BIGINT) AS n_files").replace(", sum(k) AS checked", ""),
)
def package_table(spark: SparkSession, d: str) -> DataFrame:
    """Files of each package and its dominant language, the first in order of equals."""
    k = files(spark, d).groupBy("module", "language").agg(F.count("*").alias("k"))
    first = F.min_by("language", F.struct(-F.col("k"), "language"))
    return k.groupBy(F.col("module").alias("package")).agg(F.sum("k").alias("n_files"), first.alias("dominant"))


@query(
    "production_edges",
    f"""WITH {EDGES_SQL} SELECT src, dst FROM edges EXCEPT SELECT src, dst FROM all_edges WHERE w < 10""",
)
def production_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges less those that only tests have."""
    tests = all_edges(spark, d).where("w < 10").select("src", "dst")
    return edges(spark, d).join(tests, ["src", "dst"], "left_anti")


@query(
    "projection_parity",
    """SELECT 'only_left' AS side, count(*) AS n FROM (SELECT o_orderstatus, o_custkey FROM orders EXCEPT ALL
         SELECT o_orderstatus, o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT')
       UNION ALL SELECT 'only_right', 0""",
)
def projection_parity(spark: SparkSession, d: str) -> DataFrame:
    """What two projections hold that the other doesn't, as multisets."""
    a = table(spark, d, "orders").select("o_orderstatus", "o_custkey", "o_orderpriority")
    b = a.where("o_orderpriority <> '1-URGENT'").drop("o_orderpriority")
    a = a.drop("o_orderpriority")
    sides = [("only_left", a.exceptAll(b)), ("only_right", b.exceptAll(a))]
    left, right = (x.agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n") for s, x in sides)
    return left.unionAll(right)


@query(
    "snapshot_diff",
    """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P'),
    n AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS v
          FROM orders WHERE o_orderstatus <> 'F')
    SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'deleted' ELSE 'modified' END AS change
    FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.v <> n.v""",
)
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Rows added, modified or deleted between two snapshots."""
    o = table(spark, d, "orders")
    new = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    old = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return op.snapshot_diff(old, o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k"), new.alias("v")), "k", "v")
