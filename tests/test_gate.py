"""Checks of bundles, and orientation in their graphs."""

import shutil

from pyspark.sql import functions as F

from graphloom.operators import constraints as cs
from graphloom.sources import artifacts as ar
from graphloom.sources import gate

TRIPLE = "s string, p string, o string, o_kind string, datatype string, lang string"
FILE = "id bigint, language string, is_source boolean, size int, n_errors int, n_symbols int, n_imports int"
CLASSES = {"files": "x:File", "chunks": "x:Chunk", "concepts": "x:Concept"}
SHAPE = cs.Shape("File", "files", "id", [cs.Property("language", {"min_count": 1})])


def bundle(spark, place, meta, files=((1, "c", True, 5, 0, 1, 2), (2, "c", True, 5, 0, 3, 0))):
    rows = [(f"f:{f[0]}", ar.TYPE, "x:File", "iri", None, None) for f in files] + [("c:1", ar.TYPE, "x:Chunk", "iri", None, None)]
    tables = {"files": spark.createDataFrame(list(files), FILE), "imports": spark.createDataFrame([(1, 2)], "src bigint, dst bigint")}
    ar.emit(tables, spark.createDataFrame(rows, TRIPLE), str(place), meta)
    return str(place)


def failed(df):
    return {(r.check, r.name) for r in df.collect() if not r.ok}


def test_a_bundle_passes_and_fails(spark, tmp_path):
    good = bundle(spark, tmp_path / "good", {"counts": {"files": 2, "chunks": 1, "unasked": 9}, "degradations": {}})
    rows = gate.check(spark, good, CLASSES, shapes=[SHAPE]).collect()
    assert all(r.ok for r in rows) and {(r.check, r.name) for r in rows} >= {("recount", "files"), ("digest", "triples"), ("budget", "resolved"), ("conforms", "File")}
    assert failed(gate.check(spark, good, CLASSES)) == {("conforms", "skipped")}
    assert failed(gate.check(spark, good, CLASSES, gate.Budgets(unchecked_shapes=True))) == set()
    assert failed(gate.check(spark, good, CLASSES, gate.Budgets(least_resolved=0.6), shapes=[SHAPE])) == {("budget", "resolved")}

    files = [(i, None if i < 4 else "c", True, 5, int(i == 9), 0, 1) for i in range(10)]
    bad = bundle(spark, tmp_path / "bad", {"counts": {"files": 11, "concepts": 1}, "degradations": {"a": "r", "b": "r"}}, files)
    want = {("recount", "files"), ("recount", "concepts"), ("degradation", "b"), ("conforms", "File")} | {("budget", m) for m in ("parse_errors", "unlanguaged", "silent", "resolved")}
    assert failed(gate.check(spark, bad, CLASSES, accepted=["a"], shapes=[SHAPE])) == want
    shutil.rmtree(f"{bad}/files")
    got = failed(gate.check(spark, bad, CLASSES, accepted=["a", "b"], shapes=[SHAPE]))
    assert got == {("digest", "files"), ("conforms", "File"), ("budget", "tables"), ("recount", "files"), ("recount", "concepts")}
    assert ("digest", "files") not in failed(gate.check(spark, bad, CLASSES, shapes=[SHAPE], digests=False))
    shutil.rmtree(f"{bad}/graph.nt")
    assert {("digest", "triples"), ("recount", "files")} <= failed(gate.check(spark, bad, CLASSES, shapes=[SHAPE]))


def test_no_manifest_and_none_that_can_be_read(spark, tmp_path):
    (tmp_path / "odd" / "manifest").mkdir(parents=True)
    (tmp_path / "odd" / "manifest" / "part.txt").write_text("{")
    for place in ("odd", "none"):
        rows = gate.check(spark, str(tmp_path / place), CLASSES).collect()
        assert [(r.check, r.ok) for r in rows] == [("manifest", False)]


def test_measures_of_nothing(spark):
    files, imports = spark.createDataFrame([], FILE), spark.createDataFrame([], "src int")
    assert tuple(gate.ledger(files, imports).first()) == (None, None, 0.0, None)
    assert failed(gate._within(gate.ledger(files, imports), gate.Budgets())) == set()
    odd = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "c", True, 3, None, None, None)], FILE)
    assert tuple(gate.ledger(odd, imports).first()) == (0.0, 0.5, 1.0, None)


def test_orientation(spark):
    rows = [("a", ar.TYPE, "C", None), ("a", ar.TYPE, "D", None), ("a", "p", "1", None), ("a", "p", "1", None), ("a", "p", "1", "en"), ("a", "q", "2", None)]
    rows += [("b", ar.TYPE, "C", None), ("b", "p", "3", None), ("z", "p", "4", None), (None, None, "malformed", None)]
    df = spark.createDataFrame([(s, p, o, "literal", None, x) for s, p, o, x in rows], TRIPLE)
    got = {tuple(r) for r in gate.orient(df).collect()}
    assert got == {("C", None, 2, 2), ("C", "p", 2, 3), ("C", "q", 1, 1), ("D", None, 1, 1), ("D", "p", 1, 2), ("D", "q", 1, 1), (None, None, 1, 1), (None, "p", 1, 1)}
    assert gate.orient(df.where(F.lit(False))).collect() == []
