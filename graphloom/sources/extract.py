"""Symbols and imports of source files: an Arrow-batched map with a parser or a table of patterns for each language.

Python is read by its own parser, JSON and YAML by theirs, and by patterns SQL, shell, HTML, CSS, PHP, COBOL, Dart, Clojure,
assembly, Kconfig, devicetree and Make. No grammar package is installed for TypeScript and JavaScript, Rust, Go, Java,
Kotlin, Swift, Ruby, C, C++, Objective-C and CFML: they are scanned by their tokens (`lexical`), which finds declarations,
imports and calls but no syntax errors. Files of any other language come back with the error `no_parser`.

A file that can't be read gives an error and never fails the task.
"""

from __future__ import annotations

import ast
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import normal_path
from graphloom.operators.relational import shuffled
from graphloom.sources import lexical

#: Patterns by language: (kind, expression); the first group is the name. `import` rows are specs to resolve.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "sql": [
        (kind, rf"(?im)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?{word}\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)")
        for kind, word in [("table", "table"), ("view", "(?:materialized\\s+)?view"), ("function", "function"),
                           ("procedure", "procedure"), ("index", "(?:unique\\s+)?index"), ("trigger", "trigger")]
    ] + [("import", r"(?m)^\s*\\ir?\s+(\S+)"), ("import", r"(?im)^\s*(?:@@?|source\s+)(\S+\.sql)")],
    "shell": [
        ("function", r"(?m)^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{"),
        ("function", r"(?m)^\s*function\s+([A-Za-z_][\w-]*)\s*\{"),
        ("import", r"(?m)^\s*(?:source|\.)\s+[\"']?([^\s\"';]+)"),
    ],
    "html": [
        ("id", r"(?i)\bid\s*=\s*[\"']([^\"']+)"),
        ("import", r"(?i)<(?:a|link)\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)"),
        ("import", r"(?i)<(?:script|img|iframe|source)\b[^>]*?\bsrc\s*=\s*[\"']([^\"']*)"),
    ],
    "css": [
        ("rule", r"(?m)^\s*((?!(?:from|to|[\d.]+%)[\s,{])[^@{}/\s][^{}]*?)\s*\{"),
        ("keyframes", r"@keyframes\s+([\w-]+)"),
        ("import", r"@(?:import|use|forward)\s+(?:url\()?[\"']([^\"']+)"),
    ],
    "php": [
        ("class", r"(?m)^\s*(?:abstract\s+|final\s+)*class\s+(\w+)"),
        ("interface", r"(?m)^\s*interface\s+(\w+)"),
        ("trait", r"(?m)^\s*trait\s+(\w+)"),
        ("function", r"(?m)^\s*(?:(?:public|protected|private|static|final|abstract)\s+)*function\s+&?(\w+)"),
        ("import", r"(?m)^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)"),
        ("import", r"(?:require|include)(?:_once)?\s*\(?\s*[\"']([^\"']+)"),
    ],
    "cobol": [
        ("program", r"(?im)^.{0,7}\s*program-id\.\s*([\w-]+)"),
        ("section", r"(?im)^.{0,7}\s*([\w-]+)\s+section\s*\."),
        ("import", r"(?i)\bcopy\s+[\"']?([\w-]+)"),
        ("call", r"(?i)\bcall\s+[\"']([\w-]+)"),
    ],
    "dart": [
        ("class", r"(?m)^\s*(?:abstract\s+|sealed\s+|final\s+|base\s+)*class\s+(\w+)"),
        ("mixin", r"(?m)^\s*(?:base\s+)?mixin\s+(\w+)"),
        ("enum", r"(?m)^\s*enum\s+(\w+)"),
        ("extension", r"(?m)^\s*extension\s+(\w+)"),
        ("function", r"(?m)^(?:[\w<>?,\s]+\s)?(\w+)\s*\([^;{]*\)\s*(?:async\*?\s*)?(?:\{|=>)"),
        ("import", r"(?m)^\s*(?:import|export|part)\s+[\"']([^\"']+)"),
    ],
    "clojure": [
        ("namespace", r"\(ns\s+(?:\^\S+\s+)*([\w.*+!?<>=-]+)"),
        ("definition", r"\(def(?:n-?|macro|multi|protocol|record|type|once)?\s+(?:\^\S+\s+)*([^\s()\[\]{}]+)"),
        ("import", r"\[([a-z][\w.-]*\.[\w.-]+)(?:\s+:(?:as|refer)|\])"),
    ],
    "asm": [("label", r"(?m)^([A-Za-z_.$][\w.$]*):"), ("global", r"(?m)^\s*\.glob[a]?l\s+(\S+)"),
            ("import", r"(?m)^\s*(?:#|\.)include\s+[<\"]([^>\"]+)")],
    "kconfig": [("config", r"(?m)^\s*(?:menu)?config\s+(\w+)"), ("import", r"(?m)^\s*source\s+\"([^\"]+)")],
    "devicetree": [("node", r"(?m)^\s*(?:\w+:\s*)?([\w,.+/-]+(?:@[\w,]+)?)\s*\{"),
                   ("import", r"(?m)^\s*(?:#include|/include/)\s+[<\"]([^>\"]+)")],
    "make": [("target", r"(?m)^([\w./%-]+)\s*:(?!=)"), ("import", r"(?m)^\s*-?include\s+(\S+)")],
}
PATTERNS["scss"] = PATTERNS["css"]
COLUMNS = ["path", "kind", "name", "parent", "begin_line", "end_line", "begin_byte", "end_byte", "error"]
SCHEMA = ("path string, kind string, name string, parent string, begin_line int, end_line int, begin_byte bigint, "
          "end_byte bigint, error string")  # fmt: skip


def python_items(text: str) -> Iterator[tuple]:
    """Classes, functions and imports; relative imports keep their dots."""
    starts = [0]
    for line in text.encode().splitlines(keepends=True):
        starts.append(starts[-1] + len(line))

    def visit(node: ast.AST, parent: str | None) -> Iterator[tuple]:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if parent else "function"
                begin = min([x.lineno, *(d.lineno for d in x.decorator_list)])
                at = starts[begin - 1], starts[x.end_lineno - 1] + x.end_col_offset
                yield kind, x.name, parent, begin, x.end_lineno, *at
                yield from visit(x, x.name if kind == "class" else parent)
            elif isinstance(x, ast.Import):
                yield from (("import", a.name, None, x.lineno, x.end_lineno, 0, 0) for a in x.names)
            elif isinstance(x, ast.ImportFrom):
                base = "." * x.level + (x.module or "")
                dot = "" if base.endswith(".") else "."
                yield from (("import", f"{base}{dot}{a.name}", None, x.lineno, x.end_lineno, 0, 0) for a in x.names)
            else:
                yield from visit(x, parent)

    yield from visit(ast.parse(text), None)


def key_items(doc: object) -> Iterator[tuple]:
    """Top-level keys, and references in them."""

    def refs(x: object) -> Iterator[str]:
        if isinstance(x, dict):
            for k, v in x.items():
                if k == "$ref" and isinstance(v, str):
                    yield v
                else:
                    yield from refs(v)
        elif isinstance(x, list):
            for v in x:
                yield from refs(v)

    if isinstance(doc, dict):
        yield from (("key", str(k), None, None, None, 0, 0) for k in doc)
    yield from (("import", r, None, None, None, 0, 0) for r in sorted(set(refs(doc))))


def pattern_items(language: str, text: str) -> Iterator[tuple]:
    lines = [m.start() for m in re.finditer("\n", text)]
    found = []
    for kind, expression in PATTERNS[language]:
        for m in re.finditer(expression, text):
            line = bisect_right(lines, m.start(1) - 1) + 1
            found.append((m.start(1), kind, m[1].strip('"'), line, m.start(), m.end()))
    found = sorted({x[:2]: x for x in found}.values())
    places = [(at, at + len(name)) for at, _, name, *_ in found]
    if language in lexical.BODIES:  # a declaration runs to the end of its body
        own = lexical.extents(language, text, [x[4:] for x in found])
        places = [p if x[1] in ("import", "call") else q for x, p, q in zip(found, places, own)]
    first, byte, last = 0, {}, 0
    for at in sorted({x for p in places for x in p}):
        first += len(text[last:at].encode("utf-8", "surrogatepass"))
        byte[at], last = first, at
    for (_, kind, name, line, *_), (begin, end) in zip(found, places):
        end_line = max(line, bisect_right(lines, end - 2) + 1)
        yield kind, name, None, line, end_line, byte[begin], byte[end]


def _yaml(text: str) -> Iterator[tuple]:
    import yaml

    for doc in yaml.safe_load_all(text):
        yield from key_items(doc)


PARSERS: dict[str, Callable[[str], Iterator[tuple]]] = {
    "python": python_items,
    "json": lambda t: key_items(json.loads(t)),
    "yaml": _yaml,
    **{name: (lambda t, n=name: pattern_items(n, t)) for name in PATTERNS},
    **{name: (lambda t, n=name: lexical.items(n, t)) for name in lexical.LANGUAGES},
}


def extract(files: DataFrame) -> DataFrame:
    """Items of files (path, language, text); rows with an error have no item."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, language, text in zip(f["path"], f["language"], f["text"]):
                parser = PARSERS.get(language)
                if parser is None:
                    out.append((path, *[None] * 7, "no_parser"))
                    continue
                try:
                    out += [(path, *item, None) for item in parser(text or "")]
                except Exception as e:  # what is wrong with one file is data about it
                    out.append((path, *[None] * 7, f"parse_error:{type(e).__name__}"))
            yield pd.DataFrame(out, columns=COLUMNS)

    return files.select("path", "language", "text").mapInPandas(run, SCHEMA)


def references(files: DataFrame) -> DataFrame:
    """(path, kind, src, dst, line): names that functions call and types derive from, of Python and the scanned languages.

    Files that can't be read have none; `extract` reports their errors.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, language, text in zip(f["path"], f["language"], f["text"]):
                try:
                    out += [(path, *r) for r in lexical.references(language, text or "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(out, columns=["path", "kind", "src", "dst", "line"])

    known = files.where(F.col("language").isin("python", *lexical.LANGUAGES)).select("path", "language", "text")
    return known.mapInPandas(run, "path string, kind string, src string, dst string, line int")


def resolve_references(refs: DataFrame, items: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): the file that declares what is referred to.

    A name of the same file comes first (`exact`), then one that a file imported from there declares (`import`; imports
    has path and target), then one that a single file declares (`heuristic`). Names that several files declare, and
    those that none does, stay unresolved, with the reason. Names are counted before they are joined, so a name of
    thousands of files is one row there.
    """
    declared = items.where("error IS NULL AND kind NOT IN ('import', 'call', 'key')").select("path", "name").distinct()
    by_name = declared.groupBy(F.col("name").alias("dst")).agg(
        F.count("*").alias("n"), F.min("path").alias("only")
    )
    here = declared.select("path", F.col("name").alias("dst"), F.lit(True).alias("here"))
    there = declared.select(F.col("path").alias("target"), F.col("name").alias("dst"))
    wanted = refs.select("path", "dst").distinct()
    imported = (
        wanted.join(imports.select("path", "target").distinct(), "path")
        .join(there, ["target", "dst"])
        .groupBy("path", "dst")
        .agg(F.min("target").alias("target"))
    )
    met = wanted.join(here, ["path", "dst"], "left").join(imported, ["path", "dst"], "left").join(by_name, "dst", "left")
    how = F.when(F.col("here"), "exact").when(F.col("target").isNotNull(), "import").when(F.col("n") == 1, "heuristic")
    to = F.when(F.col("here"), F.col("path")).otherwise(F.coalesce("target", F.when(F.col("n") == 1, F.col("only"))))
    reason = F.when(F.col("n") > 1, "ambiguous").otherwise("undeclared")
    named = met.select("path", "dst", how.alias("how"), to.alias("target"), reason.alias("reason"))
    all_refs = refs.join(named, ["path", "dst"])
    edges = all_refs.where("how IS NOT NULL").select("path", "kind", "src", "target", "dst", "line", "how")
    return edges, all_refs.where("how IS NULL").select("path", "kind", "src", "dst", "line", "reason")


def chunks(files: DataFrame, items: DataFrame) -> DataFrame:
    """(chunk_id, path, kind, symbol, parent, lines, bytes, text): each file as a whole, and each symbol of it."""
    n = F.octet_length("text").cast("bigint")
    whole = files.select(
        "path",
        F.lit("file").alias("kind"),
        F.lit(None).cast("string").alias("symbol"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(1).alias("begin_line"),
        F.size(F.split("text", "\n", -1)).alias("end_line"),
        F.lit(0).cast("bigint").alias("begin_byte"),
        n.alias("end_byte"),
        "text",
    )
    named = items.where("error IS NULL AND kind NOT IN ('import', 'call', 'key')").join(files.select("path", "text"), "path")
    body = F.decode(
        F.substring(F.encode("text", "UTF-8"), (F.col("begin_byte") + 1).cast("int"), (F.col("end_byte") - F.col("begin_byte")).cast("int")),
        "UTF-8",
    )
    parts = named.select(
        "path", "kind", F.col("name").alias("symbol"), "parent", "begin_line", "end_line", "begin_byte", "end_byte", body.alias("text")
    )
    out = whole.unionByName(parts)
    return out.withColumn("chunk_id", chunk_id())


def chunk_id() -> Column:
    """path#kind:Parent.symbol:L..-L..:b..-.. of a chunk's columns; the bytes make it unique."""
    name = F.concat_ws(".", "parent", "symbol")
    return F.format_string("%s#%s:%s:L%d-L%d:b%d-%d", "path", "kind", name, "begin_line", "end_line", "begin_byte", "end_byte")


def hash_vectors(texts: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, v array<float>): exact vectors from the digests of "k\\0text", their bytes as signed numbers, at unit length."""
    import hashlib

    import numpy as np

    kind = dict(texts.dtypes)[key]

    def one(t: str) -> list[float]:
        raw = b"".join(hashlib.sha256(f"{k}\0{t}".encode()).digest() for k in range(-(-dims // 32)))[:dims]
        v = np.frombuffer(raw, np.int8).astype(np.float32)
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "v": [one(t or "") for t in f[text]]})

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, v array<float>")


# -- imports to files


def resolve_relative(specs: DataFrame, paths: DataFrame, endings: list[str]) -> DataFrame:
    """(path, spec, target): specs resolved against their file's folder, then the root, with each ending in turn.

    Addresses and anchors resolve to nothing; fragments and queries are cut off. The first candidate that is a file wins.
    """
    clean = F.regexp_replace("spec", "[?#].*$", "")
    local = specs.where(~F.col("spec").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//|#)") & (clean != ""))
    folder = F.regexp_replace("path", "[^/]*$", "")
    bases = F.array(F.concat(folder, clean), F.regexp_replace(clean, "^/+", ""))
    ends = F.array(*map(F.lit, endings))
    both = F.flatten(F.transform(bases, lambda b: F.transform(ends, lambda e: F.concat(b, e))))
    tried = local.select("path", "spec", F.posexplode(both).alias("prio", "raw"))
    named = tried.select("path", "spec", "prio", normal_path(F.col("raw")).alias("target"))
    met = named.join(paths.select(F.col("path").alias("target")).distinct(), "target")
    return met.where("target <> path").groupBy("path", "spec").agg(F.min_by("target", "prio").alias("target"))


def resolve_python(specs: DataFrame, paths: DataFrame, roots: list[str]) -> DataFrame:
    """(path, spec, target, how): a module by its full name, its package, or a unique dotted suffix.

    Leading dots are taken from the importing file's package. A name with several files behind it resolves to none.
    """
    module = F.regexp_replace(F.regexp_replace("path", r"(?:/__init__)?\.pyi?$", ""), "/", ".")
    files = paths.where(F.col("path").rlike(r"\.pyi?$"))
    for root in sorted(roots, key=len, reverse=True):
        if root:
            module = F.when(F.startswith("path", F.lit(root + "/")), F.substring(module, F.lit(len(root) + 2), F.length(module))).otherwise(module)
    index = files.select("path", module.alias("m"))
    package = F.when(F.endswith("path", F.lit("__init__.py")), F.split("m", r"\.")).otherwise(
        F.slice(F.split("m", r"\."), F.lit(1), F.size(F.split("m", r"\.")) - 1)
    )
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    mine = specs.join(shuffled(index.select("path", package.alias("pkg"))), "path")
    up = F.slice("pkg", F.lit(1), F.greatest(F.size("pkg") - dots + 1, F.lit(0)))
    full = F.when(dots > 0, F.concat_ws(".", up, F.nullif(F.regexp_replace("spec", r"^\.+", ""), F.lit("")))).otherwise(F.col("spec"))
    wanted = mine.select("path", "spec", full.alias("full"), (dots > 0).alias("relative"))
    parent = F.regexp_replace("full", r"\.[^.]*$", "")
    exact = wanted.select("path", "spec", F.explode(F.array(
        F.struct(F.lit(0).alias("prio"), F.col("full").alias("m")), F.struct(F.lit(1).alias("prio"), parent.alias("m"))
    )).alias("c")).select("path", "spec", "c.prio", "c.m")
    unique = index.groupBy("m").agg(F.min("path").alias("target"), F.max("path").alias("x")).where("target = x").drop("x")
    by_name = exact.join(shuffled(unique), "m")
    parts = F.split("m", r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    suffixes = index.where(F.size(parts) > 1).select("path", F.explode(ends).alias("m"))
    tails = suffixes.groupBy("m").agg(F.min("path").alias("target"), F.max("path").alias("x")).where("target = x").drop("x")
    by_tail = exact.join(shuffled(wanted.where("NOT relative").select("path", "spec")), ["path", "spec"], "left_semi").join(shuffled(tails), "m")
    found = by_name.select("path", "spec", "target", "prio").unionAll(
        by_tail.select("path", "spec", "target", (F.col("prio") + 2).alias("prio"))
    )
    best = found.where("target <> path").groupBy("path", "spec").agg(F.min_by("target", "prio").alias("target"), F.min("prio").alias("p"))
    return best.select("path", "spec", "target", F.when(F.col("p") < 2, "exact").otherwise("suffix").alias("how"))


def resolve_qualified(specs: DataFrame, paths: DataFrame, endings: list[str]) -> DataFrame:
    """(path, spec, target, how): dotted names to files by their unique path suffix, for Java, Kotlin and their like.

    The full name comes first, then the name without its last part (a member of a class). A package with `.*` gives each
    file of its folder. A suffix with several files behind it resolves to none.
    """
    wanted = specs.select("path", "spec", F.regexp_replace("spec", "[.]", "/").alias("q"))
    stem = F.regexp_replace("path", "(?:" + "|".join(e.replace(".", "[.]") for e in endings) + ")$", "")
    files = paths.where(stem != F.col("path")).select("path", stem.alias("stem")).distinct()
    parts = F.split("stem", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    spread = files.select("path", F.explode(tails).alias("q"))
    unique = spread.groupBy("q").agg(F.count("*").alias("n"), F.min("path").alias("target")).where("n = 1").drop("n")
    plain = wanted.where(~F.endswith("q", F.lit("/*")))
    member = F.regexp_replace("q", "/[^/]*$", "")
    tried = plain.select("path", "spec", F.explode(F.array(
        F.struct(F.lit(0).alias("prio"), F.col("q")), F.struct(F.lit(1).alias("prio"), member.alias("q"))
    )).alias("c")).select("path", "spec", "c.prio", "c.q").where("q LIKE '%/%'")
    best = tried.join(unique, "q").groupBy("path", "spec").agg(F.min_by("target", "prio").alias("target"), F.min("prio").alias("p"))
    exact = best.select("path", "spec", "target", F.when(F.col("p") == 0, "exact").otherwise("member").alias("how"))
    folders = spread.where("q LIKE '%/%'").select("path", F.regexp_replace("q", "/[^/]*$", "").alias("q"))
    package = wanted.where(F.endswith("q", F.lit("/*"))).select("path", "spec", F.regexp_replace("q", "/[*]$", "").alias("q"))
    every = package.join(folders.select("q", F.col("path").alias("target")).distinct(), "q")
    found = exact.unionByName(every.select("path", "spec", "target", F.lit("package").alias("how")))
    return found.where("target <> path").distinct()


def resolve_go(specs: DataFrame, paths: DataFrame, module: str) -> DataFrame:
    """(path, spec, target): a spec below the module's path to the first source file of its folder that is no test."""
    files = paths.where("path LIKE '%.go' AND path NOT LIKE '%\\_test.go'").select("path")
    first = files.groupBy(F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).agg(F.min("path").alias("target"))
    below = F.when(F.col("spec") == module, "").when(
        F.startswith("spec", F.lit(module + "/")), F.substring("spec", F.lit(len(module) + 2), F.length("spec"))
    )
    return specs.withColumn("dir", below).join(first, "dir").select("path", "spec", "target")
