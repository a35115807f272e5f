"""Queries over manifests and lock files that are made from `part`: one file for each part, its format by the part's number.

What each text declares or pins is written down beside it, so SQL can say what the readers must find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.codebase import sql_rows
from graphloom.plans.registry import query
from graphloom.plans.tables import table
from graphloom.sources import manifests as m

#: Name of a manifest: (text, packages it declares); {n} stands for a number.
DECLARED: dict[str, tuple[str, list[str]]] = {
    "requirements.txt": ("# tools\nlib-a{n}>=1.0\n-r other.txt\nlib_b{n}[extra]==2 ; python_version > '3'\nhttps://x.org/c.whl\n", ["lib-a{n}", "lib_b{n}"]),
    "pyproject.toml": (
        '[project]\nname = "x"\ndependencies = ["core{n}>=2", "util{n}"]\n[project.optional-dependencies]\ndev = ["test{n}~=1.0"]\n'
        '[tool.poetry.dependencies]\npython = "^3.10"\npoet{n} = "1"\n',
        ["core{n}", "util{n}", "test{n}", "poet{n}"],
    ),
    "setup.cfg": ("[metadata]\nname = x\n[options]\ninstall_requires =\n    one{n}>=1\n    two{n}\n[options.extras_require]\ndev =\n    three{n}\n", ["one{n}", "two{n}", "three{n}"]),
    "package.json": ('{"name": "x", "dependencies": {"left{n}": "^1"}, "devDependencies": {"@scope/right{n}": "2"}}', ["left{n}", "@scope/right{n}"]),
    "Cargo.toml": ('[package]\nname = "x"\n[dependencies]\nserial{n} = "1"\n[dev-dependencies]\nmock{n} = { version = "2" }\n', ["serial{n}", "mock{n}"]),
    "Gemfile": ("source 'https://rubygems.org'\ngem 'rack{n}', '~> 1'\n  gem \"spec{n}\"\n", ["rack{n}", "spec{n}"]),
    "x.gemspec": ("Gem::Specification.new do |s|\n  s.add_dependency 'json{n}', '>= 1'\n  s.add_development_dependency(\"rake{n}\")\nend\n", ["json{n}", "rake{n}"]),
    "go.mod": ("module example.com/x\n\ngo 1.21\n\nrequire example.com/one{n} v1.0.0\n\nrequire (\n\texample.com/two{n} v1.2.3\n\texample.com/three v0.1.0 // indirect\n)\n", ["example.com/one{n}", "example.com/two{n}", "example.com/three"]),
    "pubspec.yaml": ("name: x\ndependencies:\n  http{n}: ^1.0\ndev_dependencies:\n  lint{n}: any\n", ["http{n}", "lint{n}"]),
    "pom.xml": (
        '<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencies><dependency><groupId>org.a{n}</groupId><artifactId>b</artifactId>'
        "</dependency><dependency><groupId>org.c</groupId><artifactId>d{n}</artifactId><version>1</version></dependency></dependencies></project>",
        ["org.a{n}:b", "org.c:d{n}"],
    ),
    "build.gradle": ("dependencies {\n  implementation 'org.e:f{n}:1.0'\n  testImplementation(\"org.g{n}:h:2\")\n}\n", ["org.e:f{n}", "org.g{n}:h"]),
    "Package.swift": ('let package = Package(dependencies: [\n  .package(url: "https://github.com/o/kit{n}.git", from: "1.0.0"),\n  .package(url: "https://x.org/o/plain{n}", from: "2.0.0")\n])\n', ["kit{n}", "plain{n}"]),
}

#: Name of a lock file: (text, packages and versions it pins).
PINNED: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "uv.lock": ('version = 1\n[[package]]\nname = "a{n}"\nversion = "1.{n}"\n[[package]]\nname = "local"\nsource = { virtual = "." }\n', [("a{n}", "1.{n}")]),
    "Cargo.lock": ('[[package]]\nname = "c{n}"\nversion = "0.{n}.1"\n\n[[package]]\nname = "d"\nversion = "2.0.0"\n', [("c{n}", "0.{n}.1"), ("d", "2.0.0")]),
    "package-lock.json": ('{"packages": {"": {"version": "9"}, "node_modules/e{n}": {"version": "3.{n}"}, "node_modules/e{n}/node_modules/@s/f": {"version": "1"}}}', [("e{n}", "3.{n}"), ("@s/f", "1")]),
    "pnpm-lock.yaml": ("lockfileVersion: '6.0'\npackages:\n  /g{n}@1.2.3:\n    dev: true\n  /@h/i{n}@4.5.6(peer@1):\n    dev: false\n", [("g{n}", "1.2.3"), ("@h/i{n}", "4.5.6")]),
    "Gemfile.lock": ("GEM\n  remote: https://rubygems.org/\n  specs:\n    j{n} (1.{n})\n      k (>= 2)\n    k (2.1)\n\nDEPENDENCIES\n  j{n}\n", [("j{n}", "1.{n}"), ("k", "2.1")]),
    "go.sum": ("example.com/l{n} v1.0.{n} h1:abc=\nexample.com/l{n} v1.0.{n}/go.mod h1:def=\nexample.com/m v0.2.0 h1:x=\n", [("example.com/l{n}", "v1.0.{n}"), ("example.com/m", "v0.2.0")]),
    "pubspec.lock": ('packages:\n  n{n}:\n    dependency: "direct main"\n    version: "1.{n}.0"\n  o:\n    version: "2.0.0"\n', [("n{n}", "1.{n}.0"), ("o", "2.0.0")]),
    "Package.resolved": ('{"pins": [{"identity": "p{n}", "state": {"version": "1.{n}"}}, {"identity": "branch", "state": {"branch": "main"}}], "version": 2}', [("p{n}", "1.{n}")]),
    "gradle.lockfile": ("# lock\norg.q:r{n}:1.{n}=compileClasspath\norg.s:t:2.0=runtimeClasspath\nempty=\n", [("org.q:r{n}", "1.{n}"), ("org.s:t", "2.0")]),
}


def _files(spark: SparkSession, sf_dir: str, texts: dict) -> DataFrame:
    at = F.pmod("p_partkey", F.lit(len(texts))).cast("int") + 1
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), at)
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("repo"), key, F.lit("/"), pick(list(texts))).alias("path"),
        F.replace(pick([t for t, _ in texts.values()]), F.lit("{n}"), key).alias("text"),
    )


def _sql(texts: dict, columns: list[str]) -> str:
    rows = []
    for i, (name, (_, found)) in enumerate(texts.items()):
        rows += [(i, name, *([x] if isinstance(x, str) else x)) for x in found]
    filled = ", ".join(f"replace({c}, '{{n}}', CAST(p_partkey AS VARCHAR)) AS {c}" for c in columns)
    return f"""WITH w(place, name, {', '.join(columns)}) AS (VALUES {sql_rows(rows)})
    SELECT 'repo' || p_partkey || '/' || name AS path, {filled} FROM part JOIN w ON place = p_partkey % {len(texts)}"""


@query("manifest_packages", _sql(DECLARED, ["package"]))
def manifest_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that manifests of twelve formats declare. MP01-MP12."""
    return m.declared(_files(spark, sf_dir, DECLARED))


@query("locked_packages", _sql(PINNED, ["package", "version"]))
def locked_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages and versions that lock files of nine formats pin. LP01-LP09."""
    return m.pinned(_files(spark, sf_dir, PINNED))
