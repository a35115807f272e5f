from pyspark.sql import functions as F

from graphloom.sources import extract as ex

FILES = [
    ("pkg/__init__.py", "python", ""),
    ("pkg/a.py", "python", "import os\nfrom . import b\nfrom .sub.c import f as g\nclass K(B):\n    def m(self):\n        pass\n\n@d\ndef fé():\n    return 1\n"),
    ("pkg/b.py", "python", "import pkg.sub.c\nfrom sub.c import f\n"),
    ("pkg/sub/__init__.py", "python", ""),
    ("pkg/sub/c.py", "python", "async def f(): ...\n"),
    ("bad.py", "python", "def ("),
    ("x.hs", "haskell", "module X where"),
    ("db.sql", "sql", "CREATE TABLE IF NOT EXISTS t (a int);\ncreate or replace view v as select 1;\n\\i sub/other.sql\n"),
    ("sub/other.sql", "sql", ""),
    ("run.sh", "shell", "#!/bin/sh\nsource lib/u.sh\n. $X/y.sh\nfoo() {\n}\n"),
    ("lib/u.sh", "shell", ""),
    ("site/index.html", "html", '<a href="p/b.html#top">x</a><a href="http://e.com">y</a><a href="#z">z</a><script src="/site/j.js"></script><a href="../site/p/b.html?q=1">w</a>'),
    ("site/p/b.html", "html", '<p id="one">'),
    ("site/j.js", "javascript", ""),
    ("s.scss", "scss", "@use 'v';\n.a {\n}\n"),
    ("v.scss", "scss", ""),
    ("d.json", "json", '{"a": {"$ref": "e.json#/x"}, "b": 1}'),
    ("e.json", "json", "[1]"),
    ("w.yaml", "yaml", "k: 1\nl:\n  $ref: d.json\n"),
    ("m.mk", "make", "all: x\ninclude n.mk\nV := 1\n"),
]


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_items(spark):
    files = spark.createDataFrame(FILES, "path string, language string, text string")
    items = ex.extract(files).cache()
    got = rows(items.where("error IS NULL").select("path", "kind", "name", "parent"))
    assert {x for x in got if x[0] == "pkg/a.py"} == {
        ("pkg/a.py", "import", "os", None), ("pkg/a.py", "import", ".b", None), ("pkg/a.py", "import", ".sub.c.f", None),
        ("pkg/a.py", "class", "K", None), ("pkg/a.py", "method", "m", "K"), ("pkg/a.py", "function", "fé", None),
    }
    assert {x[1:3] for x in got if x[0] == "db.sql"} == {("table", "t"), ("view", "v"), ("import", "sub/other.sql")}
    assert {x[1:3] for x in got if x[0] == "run.sh"} == {("import", "lib/u.sh"), ("import", "$X/y.sh"), ("function", "foo")}
    assert {x[1:3] for x in got if x[0] == "m.mk"} == {("target", "all"), ("import", "n.mk")}
    assert {x[1:3] for x in got if x[0] == "d.json"} == {("key", "a"), ("key", "b"), ("import", "e.json#/x")}
    assert rows(items.where("error IS NOT NULL").select("path", "error")) == {
        ("bad.py", "parse_error:SyntaxError"), ("x.hs", "no_parser")
    }

    chunks = ex.chunks(files, items)
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    text = {(r.path, r.symbol): r.text for r in chunks.collect()}
    assert text["db.sql", "v"] == "create or replace view v as select 1;" and text["run.sh", "foo"] == "foo() {\n}"
    assert text["pkg/a.py", "fé"] == "@d\ndef fé():\n    return 1"
    assert text["pkg/a.py", "m"].startswith("    def m") or text["pkg/a.py", "m"].strip().startswith("def m")

    specs = items.where("kind = 'import'").select("path", F.col("name").alias("spec"))
    python = ex.resolve_python(specs.where("path LIKE '%.py'"), files, [])
    assert rows(python) == {
        ("pkg/a.py", ".b", "pkg/b.py", "exact"), ("pkg/a.py", ".sub.c.f", "pkg/sub/c.py", "exact"),
        ("pkg/b.py", "pkg.sub.c", "pkg/sub/c.py", "exact"), ("pkg/b.py", "sub.c.f", "pkg/sub/c.py", "suffix"),
    }
    others = ex.resolve_relative(specs.where("path NOT LIKE '%.py'"), files, ["", ".css", ".scss"])
    assert rows(others) == {
        ("db.sql", "sub/other.sql", "sub/other.sql"), ("run.sh", "lib/u.sh", "lib/u.sh"), ("s.scss", "v", "v.scss"),
        ("site/index.html", "p/b.html#top", "site/p/b.html"), ("site/index.html", "/site/j.js", "site/j.js"),
        ("site/index.html", "../site/p/b.html?q=1", "site/p/b.html"), ("d.json", "e.json#/x", "e.json"),
        ("w.yaml", "d.json", "d.json"),
    }


def test_hash_vectors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, t string")
    v = {r.id: r.v for r in ex.hash_vectors(df, "id", "t").collect()}
    assert v[1] == v[3] != v[2] and abs(sum(x * x for x in v[2]) - 1) < 1e-5 and len(v[4]) == 64
