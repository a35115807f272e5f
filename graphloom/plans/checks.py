"""Queries of the constraint, classification, SQL and streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import classify as cl
from graphloom.operators import constraints as cs
from graphloom.operators.scratch import checkpoint_dir
from graphloom.plans.registry import query
from graphloom.plans.tables import table
from graphloom.streaming import windows as st

SHAPES = [
    cs.Shape("Order", "orders", "o_orderkey", [
        cs.Property("o_orderstatus", {"one_of": ["F", "O"], "min_count": 1, "min_length": 1}),
        cs.Property("o_totalprice", {"min_inclusive": 50000.0}),
        cs.Property("o_orderpriority", {"pattern": "^[1-4]-"}),
        cs.Property("o_custkey", {"references": ("customer", "c_custkey")}),
    ]),
    cs.Shape("Part", "part", "p_partkey", [cs.Property("p_name", {"unique": True}), cs.Property("p_size", {"max_count": 1})]),
    cs.Shape("Nation", "nation", "n_nationkey", [cs.Property("n_regionkey", {"references": ("region", "r_regionkey")})]),
]


@query(
    "constraint_report",
    """WITH v AS (
      SELECT 'Order' AS shape, 'o_orderstatus' AS path, 'one_of' AS "constraint", o_orderkey AS focus, o_orderstatus AS value
        FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
      UNION ALL SELECT 'Order', 'o_totalprice', 'min_inclusive', o_orderkey, CAST(o_totalprice AS VARCHAR) FROM orders WHERE o_totalprice < 50000
      UNION ALL SELECT 'Order', 'o_orderpriority', 'pattern', o_orderkey, o_orderpriority FROM orders
        WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')
      UNION ALL SELECT 'Order', 'o_custkey', 'references', o_orderkey, CAST(o_custkey AS VARCHAR) FROM orders
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
      UNION ALL SELECT 'Part', 'p_name', 'unique', min(p_partkey), p_name FROM part GROUP BY p_name HAVING count(*) > 1)
    SELECT shape, path, "constraint", CAST(focus AS VARCHAR) AS focus, value FROM v""",
)
def constraint_report(spark: SparkSession, d: str) -> DataFrame:
    """The violations of declared shapes."""
    tables = {t: table(spark, d, t) for t in ("orders", "customer", "part", "nation", "region")}
    return cs.validate(tables, SHAPES)


@query(
    "bundle_gate",
    """WITH m AS (SELECT count(*) FILTER (l_returnflag = 'R') / count(*) AS unresolved, avg(l_discount) AS discount FROM lineitem)
    SELECT 'unresolved' AS metric, round(unresolved, 9) AS value, 0.3::DOUBLE AS budget, unresolved <= 0.3 AS ok FROM m
    UNION ALL SELECT 'discount', round(discount, 9), 0.5::DOUBLE, discount <= 0.5 FROM m""",
)
def bundle_gate(spark: SparkSession, d: str) -> DataFrame:
    """Ratios against their budgets."""
    m = table(spark, d, "lineitem").agg(
        (F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("unresolved"), F.avg("l_discount").alias("discount")
    )
    return cs.budgets(m, {"unresolved": 0.3, "discount": 0.5}).withColumn("value", F.round("value", 9))


@query(
    "hash_verify",
    """SELECT doc_id, sha256(coalesce(text, '')) AS digest, count(*) OVER (PARTITION BY text) AS n_copies FROM documents""",
)
def hash_verify(spark: SparkSession, d: str) -> DataFrame:
    """Q04: the digest of each file, and how many files share it."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    n = docs.groupBy("digest").agg(F.count("*").alias("n_copies"))
    return docs.join(n, "digest")


_EXT = "CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.json' WHEN 3 THEN '.png' WHEN 4 THEN '_test.go' ELSE '' END"


@query(
    "file_types",
    f"""WITH f AS (SELECT doc_id, doc_id % 6 AS e, source || '/' || lang || '/f' || doc_id || {_EXT} AS path FROM documents)
    SELECT path, CASE e WHEN 0 THEN 'source_code' WHEN 1 THEN 'documentation' WHEN 2 THEN 'source_code' WHEN 3 THEN 'asset'
      WHEN 4 THEN 'test_code' ELSE 'unknown' END AS type,
      CASE e WHEN 0 THEN 'python' WHEN 1 THEN 'markdown' WHEN 2 THEN 'json' WHEN 4 THEN 'go' END AS language,
      CASE e WHEN 4 THEN 'test' WHEN 0 THEN 'core' WHEN 2 THEN 'core' ELSE 'supporting' END AS role FROM f""",
)
def file_types(spark: SparkSession, d: str) -> DataFrame:
    """Type, language and role of each path."""
    ends = F.array(*map(F.lit, [".py", ".md", ".json", ".png", "_test.go", ""]))
    docs = table(spark, d, "documents")
    end = F.element_at(ends, (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/f"), F.col("doc_id").cast("string"), end)
    f = docs.select(path.alias("path"))
    kind = cl.file_type(F.col("path"))
    typed = f.withColumn("type", kind).withColumn("language", cl.language(F.col("path")))
    phases = typed.withColumn("phases", cl.phases(F.col("path"), F.col("type")))
    return phases.withColumn("role", cl.role(F.col("path"), F.col("type"), F.col("phases"))).drop("phases")


def drain(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream over what is there, into files, and read them."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)"


@query(
    "stream_tumbling",
    f"""SELECT epoch(b)::BIGINT AS start_s, event_type, n FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS b, event_type,
      count(*) AS n FROM events GROUP BY 1, 2), {_CLOSED} WHERE b + INTERVAL 6 HOURS <= mark""",
)
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Six-hour windows of a stream, as they are closed by the watermark."""
    events = st.read_events(spark, f"{d}/events.parquet*", EVENTS)
    closed = drain(st.tumbling(events, "ts", "6 hours", "1 hour", "event_type"), spark)
    return closed.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n")


@query(
    "stream_sessions",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES
        THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
    z AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT epoch_us(a)::BIGINT AS start_us, user_id, n FROM z, {_CLOSED} WHERE b + INTERVAL 30 MINUTES <= mark""",
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user, closed by the watermark."""
    events = st.read_events(spark, f"{d}/events.parquet*", EVENTS)
    closed = drain(st.sessions(events, "ts", "30 minutes", "1 hour", "user_id"), spark)
    return closed.select(F.unix_micros("start").alias("start_us"), "user_id", "n")
