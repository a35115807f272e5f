"""The corpus pipeline against plain versions of its stages, and the registered queries."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from graphloom.llm import queries
from graphloom.llm.common import DOCUMENT_COLUMNS
from tests.llm.test_operators import plain_groups, plain_hits, plain_lines


@pytest.fixture(scope="module")
def stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs.collect()]
    for _, f in corpus_pipeline.STAGES:
        df = f(spark, docs, d).cache()
        out.append(df.collect())
        docs = df
    return out


def texts(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_columns(stages):
    for rows in stages[:-1]:
        assert rows[0].__fields__ == DOCUMENT_COLUMNS


def test_quality_keeps_good_documents(spark, stages):
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1]}
    good, bad = ([i for i, q in label.items() if q == v] for v in (1, 0))
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i in bad) <= 0.3 * len(bad)


def test_lines(stages):
    want = {k: v for k, v in plain_lines(texts(stages[1]))}
    got = dict(texts(stages[2]))
    assert all(got[k] == want[k] for k in got)
    assert all(len((r.text or "")) == r.n_chars for r in stages[2])
    for k in want.keys() - got.keys():  # only documents without a long line go
        assert all(len(x.split()) < 5 for x in want[k].split("\n"))


def test_short_lines_stay(spark):
    long = "one line of six plain words"
    made = [
        (1, long),
        (2, f"{long}\nshort line\nanother"),
        (3, f"短い行だけの文書です\n{long}"),
        (4, long),
        (5, f"{long}\n \t\n"),
        (6, ""),
        (7, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in made], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    short = {2: "short line\nanother", 3: "短い行だけの文書です"}
    assert got == {1: (long, len(long)), **{i: (t, len(t)) for i, t in short.items()}, 6: ("", 0), 7: (None, 0)}


def test_near_copies(stages):
    want = {k[0] for k in plain_groups(texts(stages[2])) if k[0] == k[1]}
    assert {r.doc_id for r in stages[3]} == want


def test_decontamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    grams = {}
    from tests.llm.test_operators import plain_words

    for i, t in items:
        w = plain_words(t)
        for s in range(max(1, len(w) - 9)):
            grams.setdefault(tuple(w[s : s + 10]), i)
    def hit(text):
        w = plain_words(text)
        return any(tuple(w[p : p + 10]) in grams for p in range(len(w)))

    assert all(len(plain_words(t)) >= 10 for _, t in items)
    assert {r.doc_id for r in stages[4]} == {r.doc_id for r in stages[3] if not hit(r.text)}
    assert plain_hits(items[0][1], items[:1])[1] > 0


def test_tokens(stages):
    assert {r.doc_id for r in stages[5]} == {r.doc_id for r in stages[4]}
    assert all(r.round_trip for r in stages[5])


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(f in names for f in queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
