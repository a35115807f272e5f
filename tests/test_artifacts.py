"""Bundles under a manifest, Turtle, and vectors of NumPy archives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.sources import artifacts as ar

TTL = """@prefix x: <http://x/> .
PREFIX y: <http://y/>
x:a a x:File ; x:size 10, 2.5, 1e3 ; x:ok true ; x:name "A \\"q\\" \\u00e9"@en , 'b'^^x:t .
# a comment
_:n1 x:of <http://x/a#b> ;
  y:p x:a .
x:list x:is ( 1 2 ) .
z:a x:b x:c .
"""


def test_turtle(spark, tmp_path):
    (tmp_path / "g.ttl").write_text(TTL)
    got = {tuple(r) for r in ar.read_turtle(spark, str(tmp_path)).collect()}
    x, t = "http://x/", ar.XSD
    good = {
        (x + "a", ar.TYPE, x + "File", "iri", None, None), (x + "a", x + "size", "10", "literal", t + "integer", None),
        (x + "a", x + "size", "2.5", "literal", t + "decimal", None), (x + "a", x + "size", "1e3", "literal", t + "double", None),
        (x + "a", x + "ok", "true", "literal", t + "boolean", None), (x + "a", x + "name", 'A "q" é', "literal", None, "en"),
        (x + "a", x + "name", "b", "literal", x + "t", None), ("_:n1", x + "of", x + "a#b", "iri", None, None), ("_:n1", "http://y/p", x + "a", "iri", None, None),
    }
    assert {r for r in got if r[3] != "malformed"} == good
    assert len([r for r in got if r[3] == "malformed"]) == 2


def test_bundle_is_checked(spark, tmp_path):
    triples = spark.createDataFrame([("http://a", "http://p", "x", "literal", None, None)], "s string, p string, o string, o_kind string, datatype string, lang string")
    files = spark.range(5).withColumn("m", F.array("id"))
    place = str(tmp_path / "b")
    manifest = ar.emit({"files": files}, triples, place, {"k": "v"})
    assert manifest["tables"]["files"]["rows"] == 5
    held = ar.Held(spark, place)
    first = held.get()
    assert held.get() is first and first["files"].count() == 5 and first["triples"].count() == 1
    spark.range(1).withColumn("m", F.array("id")).write.mode("append").parquet(f"{place}/files")
    with pytest.raises(ValueError, match="files"):
        ar.load(spark, place)
    assert ar.load(spark, place, check=False)["files"].count() == 6


def test_vectors(spark, tmp_path):
    np.savez(tmp_path / "v.npz", ids=np.array(["a", "b"]), vectors=np.eye(2))
    assert {(r.id, tuple(r.v)) for r in ar.read_npz(spark, str(tmp_path / "v.npz")).collect()} == {("a", (1.0, 0.0)), ("b", (0.0, 1.0))}
    ar.write_vectors(ar.read_npz(spark, str(tmp_path / "v.npz")), str(tmp_path / "w"), "m")
    assert ar.read_vectors(spark, str(tmp_path / "w")).count() == 2
