"""Queries that resolve imports in made repositories, one for each part: the same small tree, with the part's number in names.

Beside each tree stands what every spec must resolve to, so SQL can say what the resolvers must find in all of them at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.codebase import sql_rows
from graphloom.plans.registry import query
from graphloom.plans.tables import table
from graphloom.sources import resolve as r


@dataclass(frozen=True)
class Tree:
    """paths; specs (path, spec, form); files (path, text); want (path, spec, target, external)."""

    paths: list[str]
    specs: list[tuple[str, str, str]]
    want: list[tuple[str, str, str | None, str | None]]
    files: list[tuple[str, str]] = field(default_factory=list)


TREES: dict[str, Tree] = {
    "ruby": Tree(
        ["app/a{n}.rb", "lib/b.rb", "app/c"],
        [("app/a{n}.rb", "../lib/b", "require_relative"), ("app/a{n}.rb", "c", "require_relative"), ("app/a{n}.rb", "gone", "require_relative"),
         ("app/a{n}.rb", "lib/b", "require"), ("app/a{n}.rb", "Rack{n}/utils", "require")],
        [("app/a{n}.rb", "../lib/b", "lib/b.rb", None), ("app/a{n}.rb", "c", "app/c", None), ("app/a{n}.rb", "lib/b", "lib/b.rb", None),
         ("app/a{n}.rb", "Rack{n}/utils", None, "rack{n}")],
    ),
    "php": Tree(
        ["src/Models/User{n}.php", "src/Special/Odd.php", "web/index.php", "web/inc.php", "odd/Thing{n}.php"],
        [("web/index.php", "App\\Models\\User{n}", "use"), ("web/index.php", "App\\Special\\Thing{n}", "use"), ("web/index.php", "Other\\X", "use"),
         ("web/index.php", "inc.php", "require"), ("web/index.php", "/abs.php", "require"), ("web/index.php", "gone.php", "include")],
        [("web/index.php", "App\\Models\\User{n}", "src/Models/User{n}.php", None), ("web/index.php", "App\\Special\\Thing{n}", "odd/Thing{n}.php", None),
         ("web/index.php", "Other\\X", None, "Other\\X"), ("web/index.php", "inc.php", "web/inc.php", None),
         ("web/index.php", "/abs.php", None, "/abs.php"), ("web/index.php", "gone.php", None, "gone.php")],
        [("composer.json", '{"autoload": {"psr-4": {"App\\\\": "src/"}}, "autoload-dev": {"psr-4": {"App\\\\Special\\\\": ["odd", "other"]}}}')],
    ),
    "dart": Tree(
        ["lib/main.dart", "lib/part{n}.dart", "packages/core/lib/src/x{n}.dart"],
        [("lib/main.dart", "dart:io", "import"), ("lib/main.dart", "package:core{n}/src/x{n}.dart", "import"), ("lib/main.dart", "package:core{n}/no.dart", "import"),
         ("lib/main.dart", "package:http/http.dart", "import"), ("lib/main.dart", "part{n}.dart", "part"), ("lib/main.dart", "gone.dart", "import")],
        [("lib/main.dart", "dart:io", None, "dart:io"), ("lib/main.dart", "package:core{n}/src/x{n}.dart", "packages/core/lib/src/x{n}.dart", None),
         ("lib/main.dart", "package:core{n}/no.dart", None, "core{n}"), ("lib/main.dart", "package:http/http.dart", None, "http"),
         ("lib/main.dart", "part{n}.dart", "lib/part{n}.dart", None)],
        [("pubspec.yaml", "name: app\n"), ("packages/core/pubspec.yaml", "# core\nname: core{n}\nversion: 1.0.0\n")],
    ),
    "swift": Tree(
        ["Sources/Kit{n}/Kit{n}.swift", "Sources/Kit{n}/A.swift", "odd/place/Z.swift", "odd/place/Y.swift", "Sources/App/main.swift"],
        [("Sources/App/main.swift", "Kit{n}", "import"), ("Sources/App/main.swift", "Odd", "import"), ("Sources/App/main.swift", "Alamo{n}", "import"),
         ("Sources/App/main.swift", "Foundation", "import"), ("Sources/App/main.swift", "Empty", "import")],
        [("Sources/App/main.swift", "Kit{n}", "Sources/Kit{n}/Kit{n}.swift", None), ("Sources/App/main.swift", "Odd", "odd/place/Y.swift", None),
         ("Sources/App/main.swift", "Alamo{n}", None, "alamo"), ("Sources/App/main.swift", "Alamo{n}", None, "https://x.org/o/alamo"),
         ("Sources/App/main.swift", "Foundation", None, "Foundation"), ("Sources/App/main.swift", "Empty", None, "Empty")],
        [("Package.swift", 'let p = Package(dependencies: [.package(url: "https://x.org/o/Alamo.git", from: "1.0.0")], targets: [\n'
          '  .target(name: "Kit{n}", dependencies: [.product(name: "Alamo{n}", package: "Alamo")]),\n'
          '  .target(name: "Odd", path: "odd/place"),\n  .target(name: "Empty"),\n  .executableTarget(name: "App")])\n')],
    ),
    "rust": Tree(
        ["src/lib.rs", "src/store{n}/mod.rs", "src/store{n}/disk.rs", "tool-x/src/lib.rs", "tool-x/src/util.rs", "src/main.rs"],
        [("src/main.rs", "crate::store{n}::disk::Disk", "use"), ("src/store{n}/disk.rs", "super::Shared", "use"), ("src/store{n}/mod.rs", "self::disk::Disk", "use"),
         ("src/main.rs", "tool_x::util::f", "use"), ("src/main.rs", "serde_json::Value", "use"), ("src/lib.rs", "super::x", "use"), ("tool-x/src/util.rs", "crate::Thing", "use")],
        [("src/main.rs", "crate::store{n}::disk::Disk", "src/store{n}/disk.rs", None), ("src/store{n}/disk.rs", "super::Shared", "src/store{n}/mod.rs", None),
         ("src/store{n}/mod.rs", "self::disk::Disk", "src/store{n}/disk.rs", None), ("src/main.rs", "tool_x::util::f", "tool-x/src/util.rs", None),
         ("src/main.rs", "serde_json::Value", None, "serde-json"), ("tool-x/src/util.rs", "crate::Thing", "tool-x/src/lib.rs", None)],
        [("Cargo.toml", '[package]\nversion = "1"\nname = "app"\n\n[dependencies]\n'), ("tool-x/Cargo.toml", '[package]\nname = "tool-x"\n')],
    ),
    "objective-c": Tree(
        ["App/V{n}.m", "App/V{n}.h", "Lib/Deep/W.h", "A/dup.h", "B/dup.h", "Vendor/Kit/Kit.h"],
        [("App/V{n}.m", "V{n}.h", "include"), ("App/V{n}.m", "Frame/W.h", "include"), ("App/V{n}.m", "dup.h", "include"),
         ("App/V{n}.m", "Kit/Kit.h", "system_include"), ("App/V{n}.m", "UIKit.Button", "module_import")],
        [("App/V{n}.m", "V{n}.h", "App/V{n}.h", None), ("App/V{n}.m", "Frame/W.h", "Lib/Deep/W.h", None), ("App/V{n}.m", "Kit/Kit.h", "Vendor/Kit/Kit.h", None),
         ("App/V{n}.m", "Kit/Kit.h", None, "Kit/Kit.h"), ("App/V{n}.m", "UIKit.Button", None, "UIKit")],
    ),
    "clojure": Tree(
        ["src/shop/my_core{n}.clj", "test/shop/my_core{n}.clj", "src/shop/web.cljs", "src/shop/main.clj"],
        [("src/shop/main.clj", "shop.my-core{n}", "require"), ("src/shop/main.clj", "shop.web", "require"), ("src/shop/main.clj", "clojure.set", "require")],
        [("src/shop/main.clj", "shop.my-core{n}", "src/shop/my_core{n}.clj", None), ("src/shop/main.clj", "shop.web", "src/shop/web.cljs", None),
         ("src/shop/main.clj", "clojure.set", None, "clojure.set")],
    ),
    "cobol": Tree(
        ["b/PAY{n}.cpy", "a/pay{n}.CBL", "main.cbl"],
        [("main.cbl", "Pay{n}", "copy"), ("main.cbl", "VENDOR", "copy"), ("main.cbl", "MAIN", "copy")],
        [("main.cbl", "Pay{n}", "a/pay{n}.CBL", None), ("main.cbl", "VENDOR", None, "VENDOR"), ("main.cbl", "MAIN", None, "MAIN")],
    ),
    "cfml": Tree(
        ["web/p{n}.cfm", "web/inc.cfm", "top.cfm", "base/Item{n}.cfc", "tags/x.cfm", "tags/y.cfc", "tags/z.txt", "web/near/N.cfc"],
        [("web/p{n}.cfm", "inc.cfm", "cfinclude"), ("web/p{n}.cfm", "/top.cfm", "cfinclude"), ("web/p{n}.cfm", "gone.cfm", "cfinclude"), ("web/p{n}.cfm", "/tags", "cfimport"),
         ("web/p{n}.cfm", "base.Item{n}", "extends"), ("web/p{n}.cfm", "near.N", "new"), ("web/p{n}.cfm", "Lib.Gone", "new"), ("web/p{n}.cfm", "base.*", "import"),
         ("web/p{n}.cfm", "Vend.*", "import")],
        [("web/p{n}.cfm", "inc.cfm", "web/inc.cfm", None), ("web/p{n}.cfm", "/top.cfm", "top.cfm", None), ("web/p{n}.cfm", "/tags", "tags/x.cfm", None),
         ("web/p{n}.cfm", "/tags", "tags/y.cfc", None), ("web/p{n}.cfm", "base.Item{n}", "base/Item{n}.cfc", None), ("web/p{n}.cfm", "near.N", "web/near/N.cfc", None),
         ("web/p{n}.cfm", "Lib.Gone", None, "lib"), ("web/p{n}.cfm", "base.*", "base/Item{n}.cfc", None), ("web/p{n}.cfm", "Vend.*", None, "vend")],
    ),
    "typescript": Tree(
        ["web/src/main.ts", "web/src/lib/a{n}.ts", "web/src/ui/index.tsx", "web/src/old.ts", "shared/types.d.ts", "web/src/exact.ts", "tools/run.js", "tools/util.mjs"],
        [("web/src/main.ts", "./lib/a{n}", "import"), ("web/src/main.ts", "./ui", "import"), ("web/src/main.ts", "./old.js", "import"), ("web/src/main.ts", "@/lib/a{n}", "import"),
         ("web/src/main.ts", "~shared/types", "import"), ("web/src/main.ts", "exact", "import"), ("web/src/main.ts", "react", "import"), ("web/src/lib/a{n}.ts", "../ui", "import"),
         ("tools/run.js", "@/lib/a{n}", "import"), ("tools/run.js", "./util", "import"), ("web/src/main.ts", "./main", "import")],
        [("web/src/main.ts", "./lib/a{n}", "web/src/lib/a{n}.ts", None), ("web/src/main.ts", "./ui", "web/src/ui/index.tsx", None), ("web/src/main.ts", "./old.js", "web/src/old.ts", None),
         ("web/src/main.ts", "@/lib/a{n}", "web/src/lib/a{n}.ts", None), ("web/src/main.ts", "~shared/types", "shared/types.d.ts", None),
         ("web/src/main.ts", "exact", "web/src/exact.ts", None), ("web/src/lib/a{n}.ts", "../ui", "web/src/ui/index.tsx", None), ("tools/run.js", "./util", "tools/util.mjs", None)],
        [("tsconfig.json", "{}"), ("web/tsconfig.json", '{"files": [], "references": [{"path": "./tsconfig.app.json"}]}'),
         ("web/tsconfig.app.json", '{\n  // the app\n  "extends": ["./tsconfig.base", "@tsconfig/node"],\n  "compilerOptions": {\n    "baseUrl": ".",\n    "paths": {"@/*": ["gone/*", "src/*"], /* one */ "exact": ["./src/exact.ts"],}\n  }\n}'),
         ("web/tsconfig.base.json", '{"extends": "./tsconfig.app.json", "compilerOptions": {"baseUrl": "nowhere", "paths": {"~shared/*": ["../shared/*"], "@/*": ["never/*"]}}}')],
    ),
    "java": Tree(
        [],
        [("A{n}.java", "com.x.B{n}", "import"), ("A{n}.java", "com.x.B{n}.Inner", "import"), ("A{n}.java", "com.x.B{n}.max", "static"), ("A{n}.java", "com.x.*", "wildcard"),
         ("A{n}.java", "org.dep.sub.T", "import"), ("A{n}.java", "java.util.concurrent.Lock", "import"), ("A{n}.java", "two.Same", "import"), ("A{n}.java", "org.dep.*", "wildcard")],
        [("A{n}.java", "com.x.B{n}", "B.java", None), ("A{n}.java", "com.x.B{n}.Inner", "B.java", None), ("A{n}.java", "com.x.B{n}.max", "B.java", None), ("A{n}.java", "com.x.*", "B.java", None),
         ("A{n}.java", "com.x.*", "C.java", None), ("A{n}.java", "org.dep.sub.T", None, "org.dep.sub:b"), ("A{n}.java", "java.util.concurrent.Lock", None, "java.util.concurrent"),
         ("A{n}.java", "two.Same", None, "two.Same"), ("A{n}.java", "org.dep.*", None, "org.dep:a")],
    ),
}

#: Languages whose specs are paths: the tree is one for all, what differs is what lies outside and what is cut off.
PATHS = ["docs/a{n}.txt", "docs/b.txt", "c.txt", "docs/s.css", "docs/_p.scss"]
PATH_SPECS: dict[str, list[tuple[str, str | None, str | None]]] = {  # spec, target, external
    "sql": [("b.txt", "docs/b.txt", None), ("../c.txt", "c.txt", None), ("C:/x", None, "C:/x"), ("/abs", None, "/abs"), ("no{n}", None, "no{n}")],
    "shell": [("./b.txt", "docs/b.txt", None), ("$HOME/x", None, "$HOME/x"), ("/etc/x", None, "/etc/x"), ("`pwd`/b", None, "`pwd`/b")],
    "html": [("b.txt#top", "docs/b.txt", None), ("b.txt?q=1", "docs/b.txt", None), ("HTTP://x.org", None, "HTTP://x.org"), ("mailto:a@b.c", None, "mailto:a@b.c"),
             ("no{n}.html#x", None, "no{n}.html#x")],
    "css": [("s", "docs/s.css", None), ("p", "docs/_p.scss", None), ("s.css", "docs/s.css", None), ("sass:math", None, "sass:math"), ("https://x/y.css", None, "https://x/y.css"),
            ("q{n}", None, "q{n}")],
    "json": [("b.txt#/x", "docs/b.txt", None), ("https://x.org/s", None, "https://x.org/s"), ("no{n}.json#/x", None, "no{n}.json#/x")],
    "yaml": [("../c.txt", "c.txt", None), ("//x.org/s", None, "//x.org/s")],
    "asm": [("b.txt", "docs/b.txt", None), ("$(D)/x", None, "$(D)/x")],
    "kconfig": [("../c.txt", "c.txt", None), ("arch/$A/Kconfig", None, "arch/$A/Kconfig")],
    "devicetree": [("b.txt", "docs/b.txt", None), ("/abs.dtsi", None, "/abs.dtsi")],
    "make": [("../c.txt", "c.txt", None), ("gone{n}.mk", None, "gone{n}.mk")],
}

#: C: quoted includes beside the file or by the only name, angled ones by the build's roots, else by the only ending.
C_PATHS = ["src/m{n}.c", "src/own.h", "lib/only.h", "inc/sys/a.h", "arch/x/asm/io.h", "arch/y/asm/io.h", "deep/net/tcp{n}.h", "p/two.h", "q/two.h"]
C_SPECS = [("own.h", "include"), ("../lib/only.h", "include"), ("only.h", "include"), ("two.h", "include"), ("sys/a.h", "system_include"), ("asm/io.h", "system_include"),
           ("net/tcp{n}.h", "system_include"), ("stdio.h", "system_include")]
C_WANT = [("own.h", "src/own.h", None), ("../lib/only.h", "lib/only.h", None), ("only.h", "lib/only.h", None), ("sys/a.h", "inc/sys/a.h", None), ("asm/io.h", None, "asm/io.h"),
          ("net/tcp{n}.h", "deep/net/tcp{n}.h", None), ("stdio.h", None, "stdio.h")]
C_FILES = [("compile_commands.json", '[{"directory": "/b", "command": "cc -I none -isysteminc/ -I/usr/include -c m.c"}, {"arguments": ["cc", "-I", "inc"]}]')]
C_SEVERAL = [("asm/io.h", "arch/x/asm/io.h"), ("asm/io.h", "arch/y/asm/io.h")]


def repositories(spark: SparkSession, sf_dir: str, rows: list[tuple], columns: str) -> DataFrame:
    """The rows in each part's repository, {n} filled in."""
    names = [c.split()[0] for c in columns.split(", ")]
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("n"))
    # a part makes many rows and its file is small, so parts are dealt to all cores first
    parts = parts.repartition(4 * spark.sparkContext.defaultParallelism, "n")
    made = F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(x, names))) for x in rows))) if rows else None
    if made is None:
        return parts.limit(0).select(F.col("n").alias("repo"), *(F.lit("").alias(c) for c in names))
    spread = parts.select(F.col("n").alias("repo"), made.alias("x"))
    return spread.select("repo", *(F.replace(F.col(f"x.{c}"), F.lit("{n}"), F.col("repo")).alias(c) for c in names))


def wanted(rows: list[tuple], columns: list[str]) -> str:
    filled = ", ".join(f"replace({c}, '{{n}}', CAST(p_partkey AS VARCHAR)) AS {c}" for c in columns)
    return f"WITH w({', '.join(columns)}) AS (VALUES {sql_rows(rows)}) SELECT CAST(p_partkey AS VARCHAR) AS repo, {filled} FROM part, w"


WANT = ["path", "spec", "target", "external"]


def _register(language: str, ids: str, resolve: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> None:
    tree = TREES[language]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        specs = repositories(spark, sf_dir, tree.specs, "path, spec, form")
        paths = repositories(spark, sf_dir, [(p,) for p in tree.paths], "path")
        return resolve(specs, paths, repositories(spark, sf_dir, tree.files, "path, text")).select("repo", *WANT)

    run.__doc__ = f"Imports of {language} resolved in every repository. {ids}."
    query(f"imports_{language.replace('-', '_')}", wanted(tree.want, WANT))(run)


_register("ruby", "IR09", lambda s, p, f: r.ruby_imports(s, p))
_register("php", "IR13, IX16", lambda s, p, f: r.php_imports(s, p, r.psr4_prefixes(f)))
_register("dart", "IR08, IX07", lambda s, p, f: r.dart_imports(s, p, r.dart_packages(f)))
_register("swift", "IR07, IX06", lambda s, p, f: r.swift_imports(s, p, *r.swift_modules(f)))
_register("rust", "IR03, IX04", lambda s, p, f: r.rust_imports(s, p, r.rust_crates(f)))
_register("objective-c", "IR11", lambda s, p, f: r.objc_imports(s, p))
_register("clojure", "IR14", lambda s, p, f: r.clojure_imports(s, p))
_register("cobol", "IR15", lambda s, p, f: r.cobol_imports(s, p))
_register("cfml", "IR12", lambda s, p, f: r.cfml_imports(s, p))
_register("typescript", "IR02, IX03", lambda s, p, f: r.script_imports(s, p, r.tsconfigs(f)))


@query("imports_java", wanted(TREES["java"].want, WANT))
def imports_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by full name, member, inner class and package, then declared groups. IR05, IR06, IX08, IX10, IX11, J21."""
    classes = [("B.java", "com.x", "B{n}"), ("C.java", "com.x", "C"), ("A{n}.java", "com.y", "A"), ("S1.java", "two", "Same"), ("S2.java", "two", "Same")]
    declared = [("org.dep:a",), ("org.dep.sub:b",), ("org.dep.sub:c",)]
    specs = repositories(spark, sf_dir, TREES["java"].specs, "path, spec, form")
    known = repositories(spark, sf_dir, classes, "path, package, name")
    return r.class_imports(specs, known, repositories(spark, sf_dir, declared, "package")).select("repo", *WANT)


def _path_query(language: str, ids: str) -> None:
    rows = PATH_SPECS[language]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        specs = repositories(spark, sf_dir, [("docs/a{n}.txt", s, "import") for s, _, _ in rows] + [("docs/a{n}.txt", "a{n}.txt", "self")], "path, spec, form")
        return r.path_imports(specs, repositories(spark, sf_dir, [(p,) for p in PATHS], "path"), language).select("repo", *WANT)

    run.__doc__ = f"Specs of {language} that are paths, resolved in every repository. {ids}."
    query(f"imports_{language}", wanted([("docs/a{n}.txt", *x) for x in rows], WANT))(run)


for _language, _ids in [("sql", "IR16"), ("shell", "IR17"), ("html", "IR18"), ("css", "IR19"), ("json", "IR20"), ("yaml", "IR21"), ("asm", "IR22"), ("kconfig", "IR22"),
                        ("devicetree", "IR22"), ("make", "IR22")]:
    _path_query(_language, _ids)


def _c(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    specs = repositories(spark, sf_dir, [("src/m{n}.c", *x) for x in C_SPECS], "path, spec, form")
    paths = repositories(spark, sf_dir, [(p,) for p in C_PATHS], "path")
    return r.c_imports(specs, paths, r.include_roots(repositories(spark, sf_dir, C_FILES, "path, text")))


@query("imports_c", wanted([("src/m{n}.c", *x) for x in C_WANT], WANT))
def imports_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Includes beside the file, by the build's roots, by the only name or ending. IR10, IX14, IX15."""
    return _c(spark, sf_dir)[0].select("repo", *WANT)


@query("imports_c_several", wanted([("src/m{n}.c", *x) for x in C_SEVERAL], ["path", "spec", "target"]))
def imports_c_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angled includes that several files answer, which stay open. IR10."""
    return _c(spark, sf_dir)[1].select("repo", "path", "spec", "target")


@query("python_roots", wanted([("lib",), ("src",), ("pkgs/a{n}",), ("tests",), ("",)], ["root"]))
def python_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that modules are counted from. IX01."""
    text = '[tool.setuptools.packages.find]\nwhere = ["lib/"]\n[tool.hatch.build.targets.wheel]\npackages = ["pkgs/a{n}/x", "top"]\n'
    files = repositories(spark, sf_dir, [("pyproject.toml", text), ("sub/pyproject.toml", "[")], "path, text")
    return r.python_roots(files, repositories(spark, sf_dir, [("src/a.py",), ("tests/t.py",)], "path"))


@query(
    "imports_python",
    """WITH w(path, spec, target, how) AS (VALUES ('/__init__.py', '.b', '/b.py', 'exact'), ('/a.py', '.sub.c.f', '/sub/c.py', 'exact'),
        ('/b.py', 'K.sub.c', '/sub/c.py', 'exact'), ('/b.py', 'subK.c.f', '/subK/c.py', 'suffix'))
    SELECT 'pk' || p_partkey || path AS path, replace(replace(spec, 'K.', 'pk' || p_partkey || '.'), 'subpk', 'sub') AS spec,
           'pk' || p_partkey || replace(target, 'K', CAST(p_partkey AS VARCHAR)) AS target, how FROM part, w""",
)
def imports_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules by their full name, relative to a package, or by a unique dotted ending. IR01, IX02."""
    from graphloom.sources.extract import resolve_python

    k = "{n}"
    paths = [("pk{n}/__init__.py",), ("pk{n}/a.py",), ("pk{n}/b.py",), ("pk{n}/sub/__init__.py",), ("pk{n}/sub/c.py",), ("pk{n}/sub{n}/c.py",)]
    specs = [("pk{n}/__init__.py", ".b"), ("pk{n}/a.py", ".sub.c.f"), ("pk{n}/b.py", "pk{n}.sub.c"), ("pk{n}/b.py", f"sub{k}.c.f"), ("pk{n}/b.py", "os.path")]
    return resolve_python(repositories(spark, sf_dir, specs, "path, spec").drop("repo"), repositories(spark, sf_dir, paths, "path").drop("repo"), [])


@query(
    "imports_go",
    """SELECT 'cmd/m' || p_partkey || '.go' AS path, 'ex.com/r/pkg' || p_partkey AS spec, 'pkg' || p_partkey || '/a.go' AS target FROM part""",
)
def imports_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages below the module's path: the first source file of the folder that is no test. IR04."""
    from graphloom.sources.extract import resolve_go

    paths = [("pkg{n}/b.go",), ("pkg{n}/a.go",), ("pkg{n}/a_test.go",), ("pkg{n}/0.txt",)]
    specs = [("cmd/m{n}.go", "ex.com/r/pkg{n}"), ("cmd/m{n}.go", "fmt"), ("cmd/m{n}.go", "ex.com/rest/pkg{n}")]
    return resolve_go(repositories(spark, sf_dir, specs, "path, spec").drop("repo"), repositories(spark, sf_dir, paths, "path").drop("repo"), "ex.com/r")
