"""Tables out of triples, markers in contents, and batches that are applied once."""

import pytest
from pyspark.sql import functions as F

from graphloom.sources import artifacts as ar
from graphloom.sources import rebuild as rb
from graphloom.streaming import windows as st

TRIPLE = "s string, p string, o string, o_kind string, datatype string, lang string"


def triple(s, p, o, kind="literal"):
    return (s, p, o, kind, None, None)


def test_pivot(spark):
    shapes = {
        "files": rb.Shape("x:File", "path", "string", "f:", (("size", "x:size", "bigint"), ("tags", "x:tag", "array<string>"))),
        "tagged": rb.Shape("x:Tagged", "id", "string", "f:", (("first", "x:tag", "string"),)),
    }
    rows = [triple("f:a", ar.TYPE, "x:File", "iri"), triple("f:a", "x:size", "10"), triple("f:a", "x:tag", "t2"), triple("f:a", "x:tag", "t1"), triple("f:a", "x:tag", "t1")]
    rows += [triple("f:b", ar.TYPE, "x:File", "iri"), triple("f:b", ar.TYPE, "x:Tagged", "iri"), triple("f:b", "x:tag", "z"), triple("g:c", ar.TYPE, "x:File", "iri"), triple("f:d", "x:size", "1")]
    got = rb.pivot(spark.createDataFrame(rows, TRIPLE), shapes)
    assert {(r.path, r.size, tuple(r.tags)) for r in got["files"].collect()} == {("a", 10, ("t1", "t2")), ("b", None, ("z",))}
    assert [tuple(r) for r in got["tagged"].collect()] == [("b", "z")]


def test_rebuild_says_what_differs(spark, tmp_path):
    shapes = {"files": rb.Shape("x:File", "path", "string", "f:", (("size", "x:size", "bigint"),))}
    files = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size bigint")
    rows = [triple(f"f:{p}", ar.TYPE, "x:File", "iri") for p in "ab"] + [triple("f:a", "x:size", "1"), triple("f:b", "x:size", "2")]
    ar.emit({"files": files}, spark.createDataFrame(rows, TRIPLE), str(tmp_path / "one"))
    tables, equal = rb.rebuild(spark, str(tmp_path / "one"), shapes)
    assert equal == {"files": True} and sorted(map(tuple, tables["files"].collect())) == [("a", 1), ("b", 2)]
    ar.emit({"files": files}, spark.createDataFrame(rows[:-1], TRIPLE), str(tmp_path / "two"))
    assert rb.rebuild(spark, str(tmp_path / "two"), shapes)[1] == {"files": False}


def test_markers(spark):
    texts = {"d1": "xabcx", "d2": "ab.c aab", "d3": None, "d4": "", "d5": "bcbc'q\n"}
    markers = ["ab", "abc", "bc", "b.c", "'q", "a", "cbc", "\n"]
    files = [(f"p{i}{k}", d) for k, d in enumerate([*texts, "d1", "lost"]) for i in range(2)]
    got = rb.find_markers(spark.createDataFrame(files, "path string, digest string"), spark.createDataFrame([*texts.items(), ("d1", "xabcx")], "digest string, text string"), markers)
    want = {(p, m) for p, d in files for m in markers if m in (texts.get(d) or "")}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    with pytest.raises(ValueError, match="markers"):
        rb.find_markers(got, got, [])


def test_a_batch_is_applied_once(spark, tmp_path):
    """The query is killed after a batch was written and before it was marked, then after it was marked; each is there once."""
    schema = "k int, v string"
    for i in range(3):
        spark.createDataFrame([(i, f"v{i}")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    applied = st.Applied(spark, str(tmp_path / "out"), schema)
    assert applied.version() == -1 and applied.read().collect() == []
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = []

    def run(after=None):
        q = st.notify_once(stream(), applied, str(tmp_path / "state"), after)
        q.awaitTermination()

    real, state = applied.add, {"n": 0}

    def dies_before_the_mark(rows, batch):
        if batch == 1 and not state["n"]:
            state["n"] = 1
            rows.write.mode("overwrite").parquet(f"{applied.place}/rows/{batch}")
            raise RuntimeError("killed")
        return real(rows, batch)

    applied.add = dies_before_the_mark
    with pytest.raises(Exception, match="killed"):
        run()
    first = applied.read()
    assert applied.version() == 0 and first.count() == 1 and applied.read() is first

    def dies_after_the_mark(batch):
        told.append(batch)
        if batch == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(dies_after_the_mark)
    run(told.append)
    assert applied.version() == 2 and told == [1, 2]  # batch 1 was replayed and did nothing
    assert sorted(map(tuple, applied.read().collect())) == [(i, f"v{i}") for i in range(3)] and applied.read() is not first
