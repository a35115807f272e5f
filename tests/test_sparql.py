"""SPARQL over a small graph: each construct against answers worked out by hand."""

import pytest

from graphloom.sources import sparql
from graphloom.sources.bundle import read_ntriples
from graphloom.sources.guard import Refused

NT = """
<http://x/a> <http://x/imports> <http://x/b> .
<http://x/b> <http://x/imports> <http://x/c> .
<http://x/c> <http://x/imports> <http://x/d> .
<http://x/d> <http://x/imports> <http://x/c> .
<http://x/a> <http://x/size> "10"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://x/b> <http://x/size> "9"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://x/c> <http://x/size> "2.5"^^<http://www.w3.org/2001/XMLSchema#decimal> .
<http://x/a> <http://x/name> "Alpha"@en .
<http://x/b> <http://x/name> "beta" .
<http://x/b> <http://x/text> "http://x/a" .
<http://x/a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x/File> .
<http://x/b> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x/File> .
<http://x/c> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x/Other> .
not a triple
"""
P = "PREFIX x: <http://x/> "
CASES = [
    ("SELECT ?s ?o WHERE { ?s x:imports ?o }", {("a", "b"), ("b", "c"), ("c", "d"), ("d", "c")}),
    ("SELECT ?s WHERE { ?s a x:File ; x:size ?n . FILTER(?n > 9.5) }", {("a",)}),
    ("SELECT ?s ?n { ?s a x:File OPTIONAL { ?s x:size ?n FILTER(?n < 10) } }", {("a", None), ("b", "9")}),
    ("SELECT ?s { ?s x:imports ?o FILTER NOT EXISTS { ?s a ?t } }", {("d",)}),
    ("SELECT ?s { ?s x:imports ?o FILTER(EXISTS { ?s a ?t FILTER(?t = x:Other) }) }", {("c",)}),
    ("SELECT ?s { ?s x:imports ?o MINUS { ?s a x:File } }", {("c",), ("d",)}),
    ("SELECT ?s { { ?s a x:File } UNION { ?s a x:Other } }", {("a",), ("b",), ("c",)}),
    ("SELECT ?o { x:a x:imports+ ?o }", {("b",), ("c",), ("d",)}),
    ("SELECT ?o { x:a x:imports* ?o }", {("a",), ("b",), ("c",), ("d",)}),
    ("SELECT ?o { x:a x:imports/x:imports ?o }", {("c",)}),
    ("SELECT ?s { x:c ^x:imports ?s }", {("b",), ("d",)}),
    ("SELECT ?o { x:a (x:imports|x:name)? ?o }", {("a",), ("b",), ("Alpha",)}),
    ("SELECT ?t (COUNT(*) AS ?n) { ?s a ?t } GROUP BY ?t HAVING(COUNT(*) > 1)", {("File", "2")}),
    ("SELECT (SUM(?n) AS ?sum) (AVG(?n) AS ?avg) (MAX(?n) AS ?max) { ?s a x:File; x:size ?n }", {("19", "9.5", "10")}),
    ("SELECT (COUNT(DISTINCT ?o) AS ?n) { ?s x:imports ?o }", {("3",)}),
    ('SELECT (GROUP_CONCAT(?n; SEPARATOR=",") AS ?g) { ?s a x:File; x:size ?n }', {("10,9",)}),
    ("SELECT ?s ?d { ?s x:size ?n BIND(?n * 2 AS ?d) FILTER(?s != x:a) }", {("b", "18"), ("c", "5")}),
    ("SELECT ?s { VALUES ?s { x:a x:d } ?s x:imports ?o }", {("a",), ("d",)}),
    ('SELECT ?s { ?s x:name ?n FILTER(REGEX(?n, "^alp", "i") && LANG(?n) = "en") }', {("a",)}),
    ('SELECT ?u { ?s x:name ?n BIND(CONCAT(UCASE(STR(?n)), "!") AS ?u) }', {("ALPHA!",), ("BETA!",)}),
    ("SELECT ?s { ?s ?p ?o FILTER(isLiteral(?o) && STRSTARTS(?o, \"http\")) }", {("b",)}),
    ("SELECT ?x { ?s x:imports ?x . ?x x:text ?t }", {("b",)}),
    ("SELECT ?s { ?s x:text ?t . ?t x:imports ?z }", set()),
    ("SELECT ?s ?n { ?s x:imports ?o { SELECT ?o (COUNT(?q) AS ?n) { ?q x:imports ?o } GROUP BY ?o } FILTER(?n = 2) }", {("b", "2"), ("d", "2")}),
    ("SELECT ?s { ?s x:size ?n FILTER(?n IN (9, 2.5)) }", {("b",), ("c",)}),
]


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("nt") / "g.nt"
    path.write_text(NT)
    return read_ntriples(spark, str(path)).cache()


@pytest.mark.parametrize("query,want", CASES, ids=range(len(CASES)))
def test_select(graph, query, want):
    got = [tuple(v and v.replace("http://x/", "") for v in r) for r in sparql.select(graph, P + query).collect()]
    assert set(got) == want and len(got) == len(want)


def test_order_and_limits(spark, graph):
    q = P + "SELECT ?s ?n { ?s x:size ?n } ORDER BY DESC(?n) LIMIT 2 OFFSET 1"
    assert [r.n for r in sparql.select(graph, q).collect()] == ["9", "2.5"]
    answer = sparql.run(spark, graph, P + "SELECT DISTINCT ?s { ?s ?p ?o } ORDER BY ?s", limit=2, seconds=60)
    assert answer.rows == [("http://x/a",), ("http://x/b",)] and answer.truncated
    assert sparql.run(spark, graph, P + "ASK { x:a x:imports x:b }", seconds=60) is True
    assert sparql.run(spark, graph, P + "ASK { x:a x:imports x:d }", seconds=60) is False


@pytest.mark.parametrize("query", [
    "INSERT DATA { x:a x:b x:c }", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "DELETE WHERE { ?s ?p ?o }", "SELECT ?s { ?s ?p ?o",
    "SELECT * { ?a x:imports ?b . ?c x:size ?d }", "SELECT ?s { ?s y:p ?o }", "SELECT ?s { ?s x:p ?o } #" + "x" * 10_000,
    "SELECT ?s { ?s x:p ?o FILTER(nothing(?o)) }", "", "SELECT ?s { ?s ?p ?o }; DROP ALL",
])
def test_refused(graph, query):
    with pytest.raises(Refused):
        sparql.select(graph, P + query)


@pytest.mark.parametrize("path", ["+", "*"])
def test_walk_from_a_known_end_is_the_closure(spark, path):
    """From one end or to one, the answers are those of the unbound path with that end."""
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("f", "a"), ("z", "y")]
    rows = [(f"http://x/{s}", "http://x/p", f"http://x/{o}", "iri", None, None) for s, o in links]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, datatype string, lang string")
    every = {(r.s, r.o) for r in sparql.select(df, f"SELECT ?s ?o {{ ?s <http://x/p>{path} ?o }}").collect()}
    for x in "abdefq":
        out = {r.o for r in sparql.select(df, f"SELECT ?o {{ <http://x/{x}> <http://x/p>{path} ?o }}").collect()}
        into = {r.s for r in sparql.select(df, f"SELECT ?s {{ ?s ^<http://x/p>{path} <http://x/{x}> }}").collect()}
        assert out == into == {o for s, o in every if s == f"http://x/{x}"}


def test_distinct_sequences_are_joined_a_step_at_a_time(spark, monkeypatch):
    """The answers are those of the pairs that a whole sequence makes, which are never made."""
    rows = [(f"http://x/s{i}", f"http://x/{p}", f"http://x/{o}", "iri", None, None) for i in range(30) for p, o in (("brand", f"b{i % 2}"), ("size", i % 7))]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, datatype string, lang string")
    b = "<http://x/brand>"
    every = sparql.select(df, f"SELECT ?s ?t {{ ?s {b}/^{b} ?t . ?s <http://x/size> <http://x/5> }}").collect()
    whole = sparql.Compiler.edges

    def edges(self, p):
        assert p[0] != "seq"
        return whole(self, p)

    monkeypatch.setattr(sparql.Compiler, "edges", edges)
    got = sparql.select(df, f"SELECT DISTINCT ?t {{ ?s {b}/^{b} ?t . ?s <http://x/size> <http://x/5> }}").collect()
    assert sorted(r.t for r in got) == sorted({r.t for r in every}) and len(every) > len(got) > 0
    both = sparql.select(df, f"SELECT DISTINCT ?s ?t {{ ?s {b}/^{b} ?t . ?s <http://x/size> <http://x/5> }}").collect()
    assert {tuple(r) for r in both} == {tuple(r) for r in every} and len(both) == len(set(both))
