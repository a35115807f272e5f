"""Dependencies that manifests declare and lock files pin.

Line formats are expressions; TOML, INI and YAML go through one Arrow-batched map with the standard parsers. A file
that can't be read declares nothing.
"""

from __future__ import annotations

import configparser
import json
import re
import tomllib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)"


def requirements(c: Column) -> Column:
    """Names of a requirements file; comments, options and addresses are none."""
    lines = F.filter(F.split(c, r"\r?\n"), lambda x: x.rlike(NAME) & ~x.rlike(r"^\s*(?:#|-|[a-z+]+://)"))
    return F.array_sort(F.array_distinct(F.transform(lines, lambda x: F.regexp_extract(x, NAME, 1))))


def package_json(c: Column) -> Column:
    groups = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
    doc = F.from_json(c, ", ".join(f"{g} map<string,string>" for g in groups))
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*(F.coalesce(F.map_keys(doc[g]), none) for g in groups))))


def gemfile(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?m)^\s*gem\s+['\"]([^'\"]+)['\"]"), 1)))


def gemspec(c: Column) -> Column:
    call = r"\.add_(?:runtime_|development_)?dependency\s*\(?\s*['\"]([^'\"]+)['\"]"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(call), 1)))


def go_mod(c: Column) -> Column:
    inside = F.regexp_extract_all(c, F.lit(r"(?s)require\s*\(([^)]*)\)"), 1)
    single = F.regexp_extract_all(c, F.lit(r"(?m)^\s*require\s+(\S+)\s+v\S+"), 1)
    block = F.flatten(F.transform(inside, lambda x: F.regexp_extract_all(x, F.lit(r"(?m)^\s*([^\s/][^\s]*)\s+v\S+"), 1)))
    return F.array_sort(F.array_distinct(F.concat(single, block)))


def gradle(c: Column) -> Column:
    call = (r"(?:implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|kapt|annotationProcessor)"
            r"\s*\(?\s*['\"]([^:'\"]+:[^:'\"]+)")  # fmt: skip
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(call), 1)))


def package_swift(c: Column) -> Column:
    last = F.regexp_extract_all(c, F.lit(r"\.package\s*\([^)]*?url:\s*\"[^\"]*?([^/\"]+?)(?:\.git)?\""), 1)
    return F.array_sort(F.array_distinct(last))


def pom(c: Column) -> Column:
    group = F.xpath(c, F.lit("//*[local-name()='dependency']/*[local-name()='groupId']/text()"))
    name = F.xpath(c, F.lit("//*[local-name()='dependency']/*[local-name()='artifactId']/text()"))
    return F.array_sort(F.array_distinct(F.zip_with(group, name, lambda a, b: F.concat_ws(":", a, b))))


PIN = "array<struct<name:string,version:string>>"


def _pins(c: Column, pattern: str) -> Column:
    """Names and versions of a pattern's two groups, in order of their names."""
    names, versions = (F.regexp_extract_all(c, F.lit(pattern), n) for n in (1, 2))
    return F.array_sort(F.array_distinct(F.arrays_zip(names.alias("name"), versions.alias("version")).cast(PIN)))


def go_sum(c: Column) -> Column:
    return _pins(c, r"(?m)^(\S+)\s+(v[^\s/]+)(?:/go\.mod)?\s+h1:")


def gemfile_lock(c: Column) -> Column:
    return _pins(c, r"(?m)^ {4}([A-Za-z0-9_.-]+) \(([^)]+)\)$")


def gradle_lockfile(c: Column) -> Column:
    return _pins(c, r"(?m)^([^#=\s:][^=\s:]*:[^=\s:]+):([^=\s:]+)=")


def package_lock(c: Column) -> Column:
    doc = F.from_json(c, "packages map<string,struct<version:string>>, dependencies map<string,struct<version:string>>")
    name = lambda k: F.regexp_replace(k, r"^.*node_modules/", "")
    none = F.array().cast(PIN)

    def entries(m: Column) -> Column:
        rows = F.transform(F.map_entries(m), lambda e: F.struct(name(e["key"]).alias("name"), e["value"]["version"].alias("version")))
        return F.coalesce(F.filter(rows, lambda r: (r["name"] != "") & r["version"].isNotNull()).cast(PIN), none)

    return F.array_sort(F.array_distinct(F.concat(entries(doc["packages"]), entries(doc["dependencies"]))))


# -- formats with a grammar


def _pyproject(text: str) -> list[str]:
    doc = tomllib.loads(text)
    project, poetry = doc.get("project", {}), doc.get("tool", {}).get("poetry", {})
    specs = [*project.get("dependencies", []), *(x for v in project.get("optional-dependencies", {}).values() for x in v)]
    names = [m[1] for s in specs if (m := re.match(NAME, s))]
    groups = [poetry.get("dependencies", {}), poetry.get("dev-dependencies", {})]
    groups += [g.get("dependencies", {}) for g in poetry.get("group", {}).values()]
    return names + [k for g in groups for k in g if k.lower() != "python"]


def _setup_cfg(text: str) -> list[str]:
    doc = configparser.ConfigParser(interpolation=None)
    doc.read_string(text)
    parts = [doc.get("options", "install_requires", fallback="")]
    parts += [v for _, v in doc.items("options.extras_require")] if doc.has_section("options.extras_require") else []
    return [m[1] for p in parts for line in p.splitlines() if (m := re.match(NAME, line))]


def _cargo(text: str) -> list[str]:
    doc = tomllib.loads(text)
    tables = [doc, *doc.get("target", {}).values(), doc.get("workspace", {})]
    return [k for t in tables for g in ("dependencies", "dev-dependencies", "build-dependencies") for k in t.get(g, {})]


def _pubspec(text: str) -> list[str]:
    import yaml

    doc = yaml.safe_load(text) or {}
    return [k for g in ("dependencies", "dev_dependencies", "dependency_overrides") for k in (doc.get(g) or {})]


def _toml_lock(text: str) -> list[tuple[str, str]]:
    return [(p["name"], p["version"]) for p in tomllib.loads(text).get("package", []) if "version" in p]


def _pubspec_lock(text: str) -> list[tuple[str, str]]:
    import yaml

    return [(k, str(v.get("version"))) for k, v in ((yaml.safe_load(text) or {}).get("packages") or {}).items()]


def _pnpm_lock(text: str) -> list[tuple[str, str]]:
    import yaml

    keys = ((yaml.safe_load(text) or {}).get("packages") or {}).keys()
    found = (re.match(r"^/?((?:@[^/@]+/)?[^/@]+)[@/]([^()_]+)", k) for k in keys)
    return [(m[1], m[2]) for m in found if m]


def _package_resolved(text: str) -> list[tuple[str, str]]:
    doc = json.loads(text)
    pins = doc.get("pins") or doc.get("object", {}).get("pins", [])
    rows = ((p.get("identity") or p.get("package"), (p.get("state") or {}).get("version")) for p in pins)
    return [(n, v) for n, v in rows if n and v]


PARSED: dict[str, Callable] = {
    "pyproject.toml": _pyproject, "setup.cfg": _setup_cfg, "Cargo.toml": _cargo, "pubspec.yaml": _pubspec,
}
LOCKED: dict[str, Callable] = {
    "uv.lock": _toml_lock, "poetry.lock": _toml_lock, "Cargo.lock": _toml_lock, "pubspec.lock": _pubspec_lock,
    "pnpm-lock.yaml": _pnpm_lock, "Package.resolved": _package_resolved,
}
EXPRESSIONS = {
    "requirements.txt": requirements, "package.json": package_json, "Gemfile": gemfile, "go.mod": go_mod,
    "build.gradle": gradle, "build.gradle.kts": gradle, "Package.swift": package_swift, "pom.xml": pom,
}
LOCK_EXPRESSIONS = {
    "go.sum": go_sum, "Gemfile.lock": gemfile_lock, "gradle.lockfile": gradle_lockfile, "package-lock.json": package_lock,
}


def _by_name(files: DataFrame, table: dict[str, Callable], schema: str, rows: Callable) -> DataFrame:
    wanted = files.where(F.substring_index("path", "/", -1).isin(list(table))).select("path", "text")

    def run(frames):
        for f in frames:
            out = []
            for path, text in zip(f["path"], f["text"]):
                try:
                    found = table[path.rsplit("/", 1)[-1]](text or "")
                except Exception:  # any malformed file declares nothing
                    found = []
                out += rows(path, found)
            yield pd.DataFrame(sorted(set(out)), columns=[c.split()[0] for c in schema.split(", ")])

    return wanted.mapInPandas(run, schema)


def _expressions(files: DataFrame, table: dict[str, Callable], last: Column) -> list[DataFrame]:
    parts = []
    for name, f in table.items():
        here = files.where(F.substring_index("path", "/", -1) == name)
        parts.append(here.select("path", F.explode(f(F.col("text"))).alias("x")))
    return parts


def declared(files: DataFrame) -> DataFrame:
    """(path, package) that the manifests among files (path, text) declare."""
    out = _by_name(files, PARSED, "path string, package string", lambda p, found: [(p, x) for x in found])
    for part in _expressions(files, EXPRESSIONS, F.col("x")):
        out = out.unionAll(part.select("path", F.col("x").alias("package")))
    specs = files.where(F.endswith("path", F.lit(".gemspec"))).select("path", F.explode(gemspec(F.col("text"))).alias("package"))
    return out.unionAll(specs).distinct()


def pinned(files: DataFrame) -> DataFrame:
    """(path, package, version) that the lock files among files (path, text) pin."""
    schema = "path string, package string, version string"
    out = _by_name(files, LOCKED, schema, lambda p, found: [(p, *x) for x in found])
    for part in _expressions(files, LOCK_EXPRESSIONS, F.col("x")):
        out = out.unionAll(part.select("path", "x.name", "x.version"))
    return out.distinct()
