"""Roles, what is summarised, other labels, and extensions of bundles."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import classify as cl
from graphloom.functions import text as tx
from graphloom.sources import artifacts as ar
from graphloom.sources import extensions as ex


def test_roles_and_targets(spark):
    rows = [("a/x.test.ts", "source_code", "typescript", []), ("specs", "asset", None, None), (None, None, None, None), ("static/schemas/.xml", "source_code", "json", ["test"])]
    df = spark.createDataFrame(rows, "path string, type string, language string, phases array<string>")
    cols = [cl.roles(F.col("path"), F.col("type"), F.col("phases")), cl.summarised(F.col("type"), F.col("language")), cl.schema_file(F.col("path"))]
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert got == [(["production", "test"], True, False), (["asset", "test"], False, False), (["unknown"], False, False), (["production", "test"], False, False)]


def test_alternate(spark):
    long = "parseHTTPRequestsOfManyFilesAndMore"
    rows = [("file", "openFiles"), ("request", long), ("file", long), ("nothing", long), (None, long), ("file", None)]
    df = spark.createDataFrame(rows, "c string, i string")
    got = [r[0] for r in df.select(tx.alternate(F.col("c"), F.col("i"))).collect()]
    assert got == ["openFiles", "Requests", "Files", long, long, None]


def test_extensions(spark, tmp_path):
    files = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, path string")
    triples = spark.createDataFrame([], ex.TRIPLE)
    seen = []
    known = ex.Extensions().enricher("b", shout=F.upper("first")).enricher("a", first=F.concat("path", F.lit("!")))

    def later(rows, made):
        seen.append(sorted(made))
        return made["m1"].select(F.col("n") + 1)

    def broken(rows, made):
        raise KeyError("gone")

    known.aggregator("m2", later).aggregator("m1", lambda rows, made: rows.agg(F.count("*").alias("n"))).aggregator("m0", broken, optional=True)
    known.contributor("c", lambda rows, made: ex.literals(rows, F.concat(F.lit("f:"), "path"), "x:shout", F.col("shout")))
    known.emitter("e", lambda rows, made: {"counts": made["m1"]})
    place = str(tmp_path / "one")
    manifest = known.emit(files, triples, place, {"degradations": {"old": "r"}})
    assert manifest["meta"]["degradations"] == {"old": "r", "m0": "KeyError: 'gone'"} and seen == [["m1"]]
    tables = ar.load(spark, place)
    assert sorted((r.id, r.shout) for r in tables["files"].collect()) == [(1, "A!"), (2, None)]
    assert [tuple(r)[:3] for r in tables["triples"].collect()] == [("f:a", "x:shout", "A!")] and tables["counts"].first().n == 2
    with pytest.raises(ValueError, match="there already"):
        known.enricher("a", other=F.lit(1))
    with pytest.raises(ValueError, match="columns already"):
        ex.Extensions().enricher("a", path=F.lit("x")).enriched(files)
    with pytest.raises(ValueError, match="tables already"):
        ex.Extensions().emitter("e", lambda rows, made: {"files": rows}).emit(files, triples, str(tmp_path / "two"))
    with pytest.raises(KeyError):
        ex.Extensions().aggregator("m", broken).emit(files, triples, str(tmp_path / "three"))
    assert not (tmp_path / "two").exists() and not (tmp_path / "three").exists()
