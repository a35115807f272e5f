"""Whole bundles: tables written together under one manifest, and read back only if they are what the manifest says.

A bundle is a folder with a Parquet folder for each table, its graph as N-Triples, Turtle and JSON-LD, and manifest.json,
which holds for each table its schema, its rows and a digest that doesn't depend on their order. The manifest is written last,
so a folder without one is no bundle. Everything is written and read by Spark's own readers and writers.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources import bundle as b

MANIFEST = "manifest"
VERSION = 1


def fingerprint(table: DataFrame) -> dict:
    """Rows and an order-free digest of a table, with its schema."""
    h = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) for c in sorted(table.columns)))
    got = table.select(h.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return {"rows": got.n, "digest": str(got.s if got.s is not None else 0), "schema": table.schema.simpleString()}


def emit(tables: dict[str, DataFrame], triples: DataFrame, place: str, meta: dict[str, object] | None = None) -> dict:
    """Write a bundle and return its manifest, with `meta` (what JSON can hold) in it. Nothing may be there before."""
    spark = triples.sparkSession
    found = {}
    for name, df in tables.items():
        df.write.parquet(f"{place}/{name}")
        found[name] = fingerprint(spark.read.parquet(f"{place}/{name}"))
    b.ntriples(triples).write.text(f"{place}/graph.nt")
    turtle(triples).write.text(f"{place}/graph.ttl")
    nodes = b.jsonld(triples)
    b.jsonld_lines(nodes).write.text(f"{place}/graph.jsonld")
    found["triples"] = fingerprint(b.read_ntriples(spark, f"{place}/graph.nt"))
    manifest = {"version": VERSION, "meta": meta or {}, "tables": found}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{place}/{MANIFEST}")
    return manifest


def read_manifest(spark: SparkSession, place: str) -> dict:
    rows = spark.read.text(f"{place}/{MANIFEST}").limit(2).collect()
    if len(rows) != 1 or (doc := json.loads(rows[0].value)).get("version") != VERSION:
        raise ValueError(f"{place} is no bundle of version {VERSION}")
    return doc


def load(spark: SparkSession, place: str, check: bool = True) -> dict[str, DataFrame]:
    """The tables of a bundle, `triples` among them. ValueError names the tables that aren't what the manifest says."""
    manifest = read_manifest(spark, place)
    out = {n: spark.read.parquet(f"{place}/{n}") for n in manifest["tables"] if n != "triples"}
    out["triples"] = b.read_ntriples(spark, f"{place}/graph.nt")
    if check and (bad := sorted(n for n, df in out.items() if fingerprint(df) != manifest["tables"][n])):
        raise ValueError(f"{place}: {', '.join(bad)} differ from the manifest")
    return out


class Held:
    """Tables of a bundle that are read again when its manifest has changed."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place, self.manifest, self.tables = spark, place, None, {}

    def get(self) -> dict[str, DataFrame]:
        now = read_manifest(self.spark, self.place)
        if now != self.manifest:
            self.manifest, self.tables = now, load(self.spark, self.place)
        return self.tables


# -- Turtle


def turtle(triples: DataFrame) -> DataFrame:
    """(value) a block for each subject, `s p o, o ; p o .`, its predicates and objects sorted, blocks in order."""
    iri = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    tail = F.when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).when(
        F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")
    )
    literal = F.concat(F.lit('"'), b.escape(F.col("o")), F.lit('"'), F.coalesce(tail, F.lit("")))
    terms = triples.select(iri(F.col("s")).alias("s"), iri(F.col("p")).alias("p"), F.when(F.col("o_kind") == "literal", literal).otherwise(iri(F.col("o"))).alias("o"))
    objects = terms.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set("o")), ", ").alias("o"))
    blocks = objects.groupBy("s").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "o"))).alias("po"))
    return blocks.select("s", F.concat("s", F.lit(" "), F.array_join("po", " ; "), F.lit(" .")).alias("value")).orderBy("s").select("value")


TERM = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')(?:@(?P<lang>[A-Za-z-]+)|\^\^(?P<type><[^>\s]*>|[\w-]*:[\w.-]*))?"""
    r"""|(?P<blank>_:[\w.-]*\w)|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<a>a(?=\s))|(?P<truth>true|false)(?![\w:])|(?P<name>[\w-]*:[\w.%-]*\w|[\w-]*:)|(?P<mark>[;,.])"""
)
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: Prefixes that a document may declare; with more it isn't read, as names under those left out couldn't be expanded.
MOST_PREFIXES = 10_000
PREFIX = r"(?i)^\s*(?:@prefix|prefix)\s+([\w-]*:)\s*<([^>]*)>\s*\.?\s*$"


def block_triples(text: str, prefixes: dict[str, str]) -> list[tuple]:
    """(s, p, o, o_kind, datatype, lang) of a subject's block; ValueError where it isn't one. Texts keep their escapes."""

    def full(name: str) -> str:
        head, _, rest = name.partition(":")
        if head + ":" not in prefixes:
            raise ValueError(f"unknown prefix {head}")
        return prefixes[head + ":"] + rest

    out: list[tuple] = []
    s = p = None
    at, want = 0, "s"
    while at < len(text):
        m = TERM.match(text, at)
        if m is None:
            raise ValueError(f"not Turtle: {text[at : at + 20]}")
        at = m.end()
        if (kind := m.lastgroup) is None:
            continue
        if kind == "mark":
            if want != "mark":
                raise ValueError("a term is missing")
            want = {";": "p", ",": "o", ".": "s"}[m["mark"]]
            continue
        if m["iri"] or m["blank"] or m["name"]:
            term = (m["iri"][1:-1] if m["iri"] else m["blank"] or full(m["name"]), "iri", None, None)
        elif m["a"]:
            term = (TYPE, "iri", None, None)
        elif m["text"]:
            kind_of = m["type"] and (m["type"][1:-1] if m["type"][0] == "<" else full(m["type"]))
            term = (m["text"][1:-1], "literal", kind_of, m["lang"])
        elif m["number"]:
            name = "double" if re.search("[eE]", m["number"]) else "decimal" if "." in m["number"] else "integer"
            term = (m["number"], "literal", XSD + name, None)
        else:
            term = (m["truth"], "literal", XSD + "boolean", None)
        if want == "s":
            s, want = term[0], "p"
        elif want == "p":
            p, want = term[0], "o"
        elif want == "o":
            out.append((s, p, *term))
            want = "mark"
        else:
            raise ValueError("a mark is missing")
    return out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, o_kind, datatype, lang) of Turtle files whose statements end at the ends of lines.

    Files are cut there, so blocks of any number are read apart; prefixes come first, as a small table. Blocks that are none
    have o_kind `malformed` and keep their text in o. Collections and nested blank nodes are malformed here.
    """
    lines = spark.read.text(path).where(F.col("value").rlike(PREFIX))
    named = lines.select(F.regexp_extract("value", PREFIX, 1).alias("k"), F.regexp_extract("value", PREFIX, 2).alias("v")).distinct()
    rows = named.limit(MOST_PREFIXES + 1).collect()  # a prefix is declared, not data
    if len(rows) > MOST_PREFIXES:
        raise ValueError(f"more than {MOST_PREFIXES} prefixes in {path}")
    prefixes = {r.k: r.v for r in rows}
    blocks = spark.read.option("lineSep", ".\n").text(path)
    body = F.regexp_replace("value", r"(?im)^\s*(?:@prefix|prefix|@base|base)\s.*$", "")
    whole = F.when(F.rtrim(body).rlike(r"\.\s*$"), body).otherwise(F.concat(body, F.lit(" .")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple] = []
            for text in f["block"]:
                try:
                    out += block_triples(text, prefixes)
                except ValueError:
                    out.append((None, None, text, "malformed", None, None))
            yield pd.DataFrame(out, columns=["s", "p", "o", "o_kind", "datatype", "lang"])

    schema = "s string, p string, o string, o_kind string, datatype string, lang string"
    found = blocks.where(body.rlike(r"\S")).select(whole.alias("block")).mapInPandas(run, schema)
    return found.withColumn("o", F.when(F.col("o_kind") == "literal", b.unescape(F.col("o"))).otherwise(F.col("o")))


# -- vectors


def write_vectors(vectors: DataFrame, place: str, model: str) -> None:
    """(id, v array<float>) with a table of their model, width, number and digest beside them."""
    vectors.write.parquet(f"{place}/vectors")
    back = vectors.sparkSession.read.parquet(f"{place}/vectors")
    width = back.agg(F.max(F.size("v")).alias("w")).first().w or 0
    meta = [(model, int(width), fingerprint(back)["rows"], fingerprint(back)["digest"])]
    vectors.sparkSession.createDataFrame(meta, "model string, width int, n bigint, digest string").coalesce(1).write.json(f"{place}/meta")


def read_vectors(spark: SparkSession, place: str) -> DataFrame:
    """What write_vectors wrote; ValueError if it isn't that any more."""
    meta, back = spark.read.json(f"{place}/meta").first(), spark.read.parquet(f"{place}/vectors")
    got = fingerprint(back)
    if (got["rows"], got["digest"]) != (meta.n, meta.digest):
        raise ValueError(f"{place}: vectors differ from their meta data")
    return back


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(id string, v array<float>) of NumPy archives with arrays `ids` and `vectors`; one archive is one task's."""
    import numpy as np

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    ids, vectors = z["ids"], z["vectors"].astype(np.float32)
                for a in range(0, len(ids), 4096):
                    yield pd.DataFrame({"id": ids[a : a + 4096].astype(str), "v": list(vectors[a : a + 4096])})

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInPandas(run, "id string, v array<float>")
