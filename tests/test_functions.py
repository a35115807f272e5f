"""Classification, text, manifests, constraints, bundles, guarded SQL."""

import fnmatch
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import classify as cl
from graphloom.functions import text as tx
from graphloom.operators import constraints as cs
from graphloom.sources import bundle, guard, manifests


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


TYPES = {
    "LICENSE.txt": "license", "Dockerfile.dev": "container", ".github/workflows/ci.yml": "ci_cd", "uv.lock": "lockfile",
    "a/requirements-dev.txt": "dependency_manifest", "x.podspec": "dependency_manifest", "Makefile": "build_script",
    "bin/rails": "build_script", ".env.local": "environment", "lib/a.g.dart": "generated", "js/x.min.js": "generated",
    "tests/a.py": "test_code", "tests/a.yaml": "source_code", "a_test.go": "test_code", "FooTest.java": "test_code",
    "Latest.java": "source_code", "lib/test_bitmap.c": "test_code", "protest.c": "source_code", "README.md": "documentation",
    "man/ls.1": "documentation", ".gitignore": "configuration", "tsconfig.json": "configuration", "a/b.py": "source_code",
    "a.toml": "configuration", "a.csv": "data", "a.PNG": "asset", "a.bin": "unknown", "tests/fixtures/x.zzz": "data",
    "RAILS_VERSION": "data", "x.js.map": "generated", ".husky/x": "configuration", "a.ttl": "data",
}


def test_file_types(spark):
    df = spark.createDataFrame([(k,) for k in TYPES], "path string")
    got = {r.path: r.t for r in df.select("path", cl.file_type(F.col("path")).alias("t")).collect()}
    assert got == TYPES
    shell = spark.createDataFrame([("scripts/go", "#!/bin/sh"), ("blob", "a\x00b")], "p string, h string")
    assert [r.t for r in shell.select(cl.file_type(F.col("p"), F.col("h")).alias("t")).collect()] == ["source_code", "binary"]


#: Paths in which several pieces of evidence meet: the earlier one counts.
CONTESTED = {
    ".github/workflows/compose.yml": "container", "tests/setup.py": "dependency_manifest", "tests/x.rake": "build_script",
    "tests/jest.config.js": "test_code", "tests/tsconfig.json": "configuration", "docs/robots.txt": "documentation",
    "tests/jquery.min.js": "generated", ".circleci/Makefile": "ci_cd", ".github/a/workflows/b/x.YAML": "ci_cd", "x/buildkite/p.yml": "ci_cd",
    "workflows/x.yml": "source_code", "a/x.cmake.in": "build_script", "src/rails": "unknown", "Fooacknowledgements.plist": "configuration",
    "a-acknowledgements.markdown": "generated", "x.dockerfile": "container", "husky/a.py": "configuration", "a.snap": "data",
    "a.txt": "source_code", "a~": "data", "Tests/a/Utilities/x": "data", "testdata/x": "data", "selftests/a.c": "test_code",
    "spec/a_helper.rb": "test_code", "COPYING.lib": "license", "copyright.py": "source_code", "my.test.TSX": "source_code",
    "AbcIT.KT": "test_code", "x_kunit.c": "test_code", "docs/a.html": "documentation", "docs/a.py": "source_code", "a.9": "documentation",
}


def test_contested_types(spark):
    df = spark.createDataFrame([(k,) for k in CONTESTED], "path string")
    got = {r.path: r.t for r in df.select("path", cl.file_type(F.col("path")).alias("t")).collect()}
    assert got == CONTESTED


def test_every_listed_value_speaks(spark):
    """Each name and extension gives its type, or one whose evidence stands before it."""
    rows = [(n, e.type, k) for k, e in enumerate(cl.EVIDENCE) for n in [*e.names, *("x" + x for x in e.extensions)]]
    before = {t: k for k, t in reversed([(k, e.type) for k, e in enumerate(cl.EVIDENCE)])}
    df = spark.createDataFrame(rows, "path string, type string, k int")
    wrong = [(r.path, r.type, r.t) for r in df.select("*", cl.file_type(F.col("path")).alias("t")).collect() if r.t != r.type and before[r.t] > r.k]
    assert not wrong


def test_m_files(spark):
    heads = [("#import <a.h>", "objective-c"), ("% a comment\nx = 1", "matlab"), ("function y = f(x)", "matlab"), ("", "objective-c"), ("// c\n% d", "objective-c")]
    df = spark.createDataFrame([("a.m", h) for h, _ in heads], "p string, h string")
    assert [r.x for r in df.select(cl.language(F.col("p"), F.col("h")).alias("x")).collect()] == [x for _, x in heads]


def test_language_layer_entry(spark):
    assert one(spark, "a/B.PY", cl.language) == "python"
    assert one(spark, "Makefile.am", cl.language) == "make"
    assert one(spark, "frontend/domain/x.py", cl.layer) == "adapter"
    assert one(spark, "domain.py", cl.layer) is None
    assert one(spark, "x/main.go", lambda c: cl.entry_point(c, F.lit("source_code"))) == "go_main"
    assert one(spark, "x/main.go", lambda c: cl.entry_point(c, F.lit("test_code"))) is None
    assert one(spark, "bin/run", lambda c: cl.entry_point(c, F.lit("source_code"))) == "shell_bin"
    assert one(spark, "tools/x.py", lambda c: cl.phases(c, F.lit("source_code"))) == ["build", "dev"]


def test_excluded(spark):
    patterns = ["vendor/cache/", "*.min.js", "docs/**", "[ab].py", "x?.c"]
    paths = ["vendor/cache", "vendor/cache/a", "vendor/cached", "a/x.min.js", "docs", "docs/a/b", "a.py", "c.py", "xy.c", "x/y.c"]

    def plain(p):
        for raw in patterns:
            t = raw.rstrip("/")
            if fnmatch.fnmatchcase(p, t) or (t.endswith("/**") and (p == t[:-3] or p.startswith(t[:-2]))):
                return True
            if not re.search(r"[*?\[]", t) and (p == t or p.startswith(t + "/")):
                return True
        return False

    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r.x for r in df.select(cl.excluded(F.col("p"), patterns).alias("x")).collect()]
    assert got == [plain(p) for p in paths]


def test_text(spark):
    assert one(spark, "parseHTTPResponse_v2", tx.split_identifier) == ["parse", "HTTP", "Response", "v", "2"]
    assert [one(spark, t, tx.canonical) for t in ("Users", "class", "us", "7", "the", "bus")] == ["user", "class", "us", None, None, "bus"]
    assert one(spark, "func", lambda c: tx.canonical(c, {"func": "function"})) == "function"
    assert [one(spark, p, tx.normal_path) for p in ("a/../b/./c", "../x", "a//b")] == ["b/c", None, "a/b"]
    assert one(spark, "a/b/c.tar.gz", tx.extension) == ".gz" and one(spark, ".bashrc", tx.extension) == ""
    assert one(spark, "a b*~é", tx.percent_encode) == "a%20b%2A~%C3%A9"

    def fnv(s):
        h = 2166136261
        for c in s.encode():
            h = (h ^ c) * 16777619 % 2**32
        return h

    assert one(spark, "src/main.rs", tx.fnv1a) == fnv("src/main.rs")
    verdicts = {"I'm sorry, no.": "refusal", "": "empty", "Empty file": None, "USER: x y z": "prompt_echo", "One. Two. Three. Four.": "sentence_count",
                "```\nGood text here.\n```": None, "a ```x``` b": "code_fence", "w " * 61: "too_many_words", "x" * 2001: "too_long", "a\x01b": "control_characters"}
    for t, want in verdicts.items():
        assert one(spark, t, lambda c: tx.rejection(F.lit("file_summary"), c)) == want, t


def test_manifests(spark):
    files = [
        ("requirements.txt", "requests>=2 # x\n-r other.txt\n# no\nDjango[argon2]==4\n"),
        ("pyproject.toml", '[project]\ndependencies=["numpy>1"]\n[tool.poetry.dependencies]\npython="3"\nrich="*"\n'),
        ("package.json", '{"dependencies":{"react":"1"},"devDependencies":{"jest":"2"}}'),
        ("Gemfile", "gem 'rails', '7'\n# gem 'no'\n"),
        ("go.mod", "module m\nrequire (\n\ta.b/c v1.0\n)\nrequire x.y/z v2.0\n"),
        ("a/Cargo.toml", "[dependencies]\nserde='1'\n[dev-dependencies]\nrand='0'\n"),
        ("pubspec.yaml", "dependencies:\n  http: any\n"),
        ("build.gradle", "implementation 'g.a:b:1'\ntestImplementation(\"c.d:e:2\")\n"),
        ("pom.xml", "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency></dependencies></project>"),
        ("setup.cfg", "[options]\ninstall_requires =\n    attrs\n"),
        ("b/pyproject.toml", "not [toml"),
        ("x.gemspec", "s.add_dependency 'rack', '1'"),
        ("go.sum", "a.b/c v1.0 h1:x=\na.b/c v1.0/go.mod h1:y=\n"),
        ("Gemfile.lock", "GEM\n  specs:\n    rails (7.0)\n      rack (>= 2)\n"),
        ("uv.lock", '[[package]]\nname="a"\nversion="1"\n'),
        ("package-lock.json", '{"packages":{"":{"version":"0"},"node_modules/x":{"version":"3"}}}'),
        ("gradle.lockfile", "# c\na.b:c:1.2=compile\nempty=\n"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    got = {}
    for r in manifests.declared(df).collect():
        got.setdefault(r.path, set()).add(r.package)
    assert got == {
        "requirements.txt": {"requests", "Django"}, "pyproject.toml": {"numpy", "rich"}, "package.json": {"react", "jest"},
        "Gemfile": {"rails"}, "go.mod": {"a.b/c", "x.y/z"}, "a/Cargo.toml": {"serde", "rand"}, "pubspec.yaml": {"http"},
        "build.gradle": {"g.a:b", "c.d:e"}, "pom.xml": {"g:a"}, "setup.cfg": {"attrs"}, "x.gemspec": {"rack"},
    }
    pins = {(r.path, r.package, r.version) for r in manifests.pinned(df).collect()}
    assert pins == {("go.sum", "a.b/c", "v1.0"), ("Gemfile.lock", "rails", "7.0"), ("uv.lock", "a", "1"),
                    ("package-lock.json", "x", "3"), ("gradle.lockfile", "a.b:c", "1.2")}


def test_constraints(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, None, -1), (2, "c!", 7)], "id int, name string, n int")
    shape = cs.Shape("S", "t", "id", [cs.Property("name", {"min_count": 1, "max_count": 1, "pattern": "^[a-z]+$"}),
                                      cs.Property("n", {"min_inclusive": 0, "datatype": "int"})])
    got = {(r["constraint"], r.focus, r.value) for r in cs.validate({"t": t}, [shape]).collect()}
    assert got == {("min_count", "2", None), ("pattern", "2", "c!"), ("min_inclusive", "2", "-1")}
    with pytest.raises(ValueError):
        cs.validate({"t": t}, [cs.Shape("S", "t", "id", [cs.Property("n", {"odd": 1})])])


def test_ntriples(spark, tmp_path):
    lines = ['<urn:a> <urn:p> <urn:b> .', '<urn:a> <urn:q> "x \\"y\\" \\\\n\\n"@en .', '_:b <urn:q> "1"^^<urn:int> .', "# no", "", "oops"]
    (tmp_path / "x.nt").write_text("\n".join(lines))
    rows = bundle.read_ntriples(spark, str(tmp_path / "x.nt"))
    assert rows.where("o_kind = 'malformed'").count() == 1
    good = rows.where("o_kind <> 'malformed'")
    assert {r.o for r in good.collect()} == {"urn:b", 'x "y" \\n\n', "1"}
    assert [r.value for r in bundle.ntriples(good).collect()] == sorted(lines[:3])
    nodes = {r.id: json.loads(r.node) for r in bundle.jsonld(good).collect()}
    assert nodes["urn:a"]["urn:p"] == ["urn:b"]


def test_jsonld(spark, tmp_path):
    doc = {"@graph": [{"@id": "a", "@type": "F"}, {"@id": "b", "@type": ["F", "G"]}, {"@id": "c"}]}
    (tmp_path / "x.jsonld").write_text(json.dumps(doc, indent=1))
    got = {r.id: r.types for r in bundle.read_jsonld(spark, str(tmp_path / "x.jsonld")).select("id", "types").collect()}
    assert got == {"a": ["F"], "b": ["F", "G"], "c": []}


def test_blobs_round_trip(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n, t in (("a.txt", "x"), ("d/b.txt", "x"), ("d/c.txt", "y")):
        (tmp_path / n).write_text(t)
    files = bundle.read_tree(spark, str(tmp_path)).select("path", "content")
    inventory = files.select("path", F.sha2("content", 256).alias("sha256"))
    store = bundle.blobs(files)
    assert {r.sha256 for r in store.collect()} == {hashlib.sha256(t).hexdigest() for t in (b"x", b"y")}
    again = bundle.reconstruct(inventory, store)
    assert bundle.verify(inventory, again).count() == 0
    changed = again.withColumn("content", F.when(F.endswith("path", F.lit("a.txt")), F.lit(b"z")).otherwise(F.col("content")))
    assert [r.verdict for r in bundle.verify(inventory, changed.where("path NOT LIKE '%c.txt'")).orderBy("verdict").collect()] == ["mismatch", "missing"]


def test_guard(spark):
    spark.range(20).createOrReplaceTempView("numbers")
    a = guard.run(spark, "SELECT id FROM numbers ORDER BY id", limit=5)
    assert a.rows[0] == ("0",) and len(a.rows) == 5 and a.truncated
    assert not guard.run(spark, "SELECT id FROM numbers LIMIT 5", limit=5).truncated
    assert guard.ask(spark, "SELECT 1 FROM numbers WHERE id = 3") and not guard.ask(spark, "SELECT 1 FROM numbers WHERE id = 99")
    assert guard.check("SELECT 'drop table x' AS t")
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO t SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "x" * 20000):
        with pytest.raises(guard.Refused):
            guard.check(bad)


def test_blank_answers_are_empty(spark):
    rows = [("\n\t \n",), ("  ",), ("\nfine words\t",), ("```\n\n```",)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(tx.rejection(F.lit("file_summary"), F.col("t")).alias("x")).collect()]
    assert got == ["empty", "empty", None, "empty"]


def test_fnv1a_beyond_ascii(spark):
    def plain(t):
        h = 2166136261
        raw = t.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619) % 2**32
        return h

    texts = ["", "a", "src/main.py", "é€", "日本", "x\U0001f600y"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.fnv1a(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [plain(t) for t in texts]
