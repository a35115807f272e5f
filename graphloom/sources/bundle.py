"""Bundles on disk: triples, JSON-LD and JSONL in and out, content-addressed blobs, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLE = r"^(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\")(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?\s*\.\s*$"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, o_kind, datatype, lang) of N-Triples files; lines that are none have o_kind `malformed` and keep their
    text in o, so that they can be counted."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~F.startswith(line, F.lit("#")))

    def part(n: int) -> Column:
        return F.regexp_extract(line, TRIPLE, n)

    ok = line.rlike(TRIPLE)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    literal = F.startswith(part(3), F.lit('"'))
    text = unescape(F.substring(part(3), F.lit(2), F.length(part(3)) - 2))
    return rows.select(
        F.when(ok, bare(part(1))).alias("s"),
        F.when(ok, bare(part(2))).alias("p"),
        F.when(~ok, line).when(literal, text).otherwise(bare(part(3))).alias("o"),
        F.when(~ok, "malformed").when(literal, "literal").otherwise("iri").alias("o_kind"),
        F.nullif(part(4), F.lit("")).alias("datatype"),
        F.nullif(part(5), F.lit("")).alias("lang"),
    )


#: What a character behind a backslash stands for (fixed values of N-Triples).
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
PARTS = r"(?s)(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\"


def unescape(c: Column) -> Column:
    """The characters of an escaped literal. An escape that isn't one stays as it is."""

    def one(part: Column) -> Column:
        code = F.substring(part, 3, 8)
        plain = F.element_at(F.create_map(*(F.lit(x) for pair in ESCAPES.items() for x in pair)), F.substring(part, 2, 1))
        return (
            F.when(~F.startswith(part, F.lit("\\")), part)
            .when(part.rlike(r"^\\u[0-9A-Fa-f]{4}"), F.decode(F.unhex(F.replace(part, F.lit("\\u"), F.lit(""))), "UTF-16BE"))
            .when(part.rlike(r"^\\U0{0,2}(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}$"), F.decode(F.unhex(code), "UTF-32"))
            .otherwise(F.coalesce(plain, part))
        )

    parts = F.regexp_extract_all(c, F.lit(PARTS), 0)
    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(c)


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for code, char in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def ntriples(triples: DataFrame) -> DataFrame:
    """Sorted N-Triples lines; they depend on the set of triples alone."""
    iri = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    tail = F.when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).when(
        F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")
    )
    literal = F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'), F.coalesce(tail, F.lit("")))
    o = F.when(F.col("o_kind") == "literal", literal).otherwise(iri(F.col("o")))
    return triples.select(F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), o, F.lit(".")).alias("value")).distinct().orderBy("value")


def read_jsonld(spark: SparkSession, path: str) -> DataFrame:
    """(id, types array<string>, node variant) of the @graph of JSON-LD documents; one type or many read alike.

    A document is one text here, whatever its layout; those with a node a line are for `scan_jsonld`, at any size.
    """
    docs = spark.read.text(path, wholetext=True)
    graph = F.from_json(F.get_json_object("value", "$['@graph']"), "array<string>")
    nodes = docs.select(F.explode(graph).alias("n"))
    kind = F.get_json_object("n", "$['@type']")
    types = F.when(F.startswith(kind, F.lit("[")), F.from_json(kind, "array<string>")).otherwise(F.array(kind))
    return nodes.select(
        F.get_json_object("n", "$['@id']").alias("id"),
        F.array_compact(types).alias("types"),
        F.try_parse_json("n").alias("node"),
    )


def jsonld(triples: DataFrame) -> DataFrame:
    """(id, node): a JSON document for each subject, its predicates and values sorted."""
    values = triples.groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("v"))
    nodes = values.groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", "v")))).alias("m"))
    return nodes.select(F.col("s").alias("id"), F.to_json("m").alias("node"))


def jsonld_lines(nodes: DataFrame) -> DataFrame:
    """(value) lines of a document (id, node as JSON text) in order of ids: a head, a node a line, a foot.

    Written with its order kept, the text is one JSON document, and every line of it can be read by itself.
    """
    body = nodes.select(F.lit(1).alias("part"), "id", F.col("node").alias("value"))
    ends = nodes.sparkSession.createDataFrame([(0, None, '{"@graph": ['), (2, None, "]}")], "part int, id string, value string")
    last = nodes.agg(F.max("id").alias("last"))
    commas = body.join(F.broadcast(last), F.lit(True), "left").withColumn(
        "value", F.when(F.col("id") < F.col("last"), F.concat("value", F.lit(","))).otherwise(F.col("value"))
    )
    return commas.drop("last").unionByName(ends).orderBy("part", "id").select("value")


def scan_jsonld(spark: SparkSession, path: str) -> DataFrame:
    """(id, types, node) of JSON-LD documents with a node a line: lines are read apart, in splits of any size."""
    line = F.regexp_replace(F.btrim(F.col("value")), ",$", "")
    rows = spark.read.text(path).select(line.alias("n")).where("n LIKE '{%}'")
    kind = F.get_json_object("n", "$['@type']")
    types = F.when(F.startswith(kind, F.lit("[")), F.from_json(kind, "array<string>")).otherwise(F.array(kind))
    nodes = rows.select(F.get_json_object("n", "$['@id']").alias("id"), F.array_compact(types).alias("types"), F.try_parse_json("n").alias("node"))
    return nodes.where("id IS NOT NULL")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with `_corrupt_record` where a line isn't one; blank lines are skipped."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path)


def write_sorted_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a total order; an empty frame still writes a (schema-less) folder."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def blobs(files: DataFrame, content: str = "content") -> DataFrame:
    """(sha256, content): each distinct content once."""
    return files.select(F.sha2(content, 256).alias("sha256"), content).dropDuplicates(["sha256"])


def reconstruct(inventory: DataFrame, store: DataFrame) -> DataFrame:
    """(path, content) from the inventory (path, sha256) and the blobs."""
    return inventory.join(store, "sha256").select("path", "content")


def verify(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """(path, verdict) of files that are missing, extra, or differ from the inventory's digest."""
    mine = files.select("path", F.sha2("content", 256).alias("found"))
    met = inventory.join(mine, "path", "full_outer")
    verdict = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("sha256").isNull(), "extra")
        .when(F.col("found") != F.col("sha256"), "mismatch")
    )
    return met.select("path", verdict.alias("verdict")).where("verdict IS NOT NULL")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, size, modified) of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
