"""Import specs to files, for each language, over many repositories at once.

Specs are (repo, path, spec, form), paths (repo, path), and config files (repo, path, text). A language says in which
order a spec may name files, as an array of candidates; all of a repository's candidates meet its paths in one join on
(repo, path), and the first that is a file wins. What no file answers is external, under the name that the language
gives it, or dropped where such a spec names no package (external is null then). A file never imports itself.

Results are (repo, path, spec, target, external).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import normal_path
from graphloom.operators.relational import shuffled
from graphloom.operators.scratch import materialize

KEYS = ["repo", "path", "spec"]


def nothing() -> Column:
    return F.lit(None).cast("string")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def head(path: str, n: Column) -> Column:
    """The first n segments of a path."""
    return F.array_join(F.slice(F.split(path, "/"), F.lit(1), n), "/")


def above(path: str) -> Column:
    """All folders above a path, the root as an empty one."""
    return F.transform(F.sequence(F.lit(0), F.size(F.split(path, "/")) - 1), lambda n: head(path, n))


def joined(base: Column, name: Column) -> Column:
    return normal_path(F.concat_ws("/", F.nullif(base, F.lit("")), name))


def beside(name: Column) -> Column:
    """A name seen from the importing file's folder."""
    return joined(folder(F.col("path")), name)


def first_file(tried: DataFrame, paths: DataFrame) -> DataFrame:
    """Specs with `candidates` and `external`: the first candidate that is a file of the repository."""
    # the outer form, as Spark would work out the candidates of the other one twice, to leave out empty arrays beforehand
    spread = tried.select(*KEYS, F.posexplode_outer("candidates").alias("prio", "target")).where("target IS NOT NULL")
    known = paths.select("repo", F.col("path").alias("target")).distinct()
    hit = spread.join(shuffled(known), ["repo", "target"]).groupBy(*KEYS).agg(F.min_by("target", "prio").alias("target"))
    met = tried.join(shuffled(hit), KEYS, "left").where("target IS NULL OR target <> path")
    found = met.select(*KEYS, "target", F.when(F.col("target").isNull(), F.col("external")).alias("external"))
    return found.where("target IS NOT NULL OR external IS NOT NULL").distinct()


def unique_file(tried: DataFrame, index: DataFrame) -> DataFrame:
    """Specs with `names` in order: the first name that exactly one file of the index (repo, name, path) bears."""
    alone = index.groupBy("repo", "name").agg(F.min("path").alias("target"), F.max("path").alias("last")).where("target = last")
    spread = tried.select(*KEYS, F.posexplode("names").alias("prio", "name"))
    hit = spread.join(shuffled(alone), ["repo", "name"]).groupBy(*KEYS).agg(F.min_by("target", "prio").alias("target"))
    met = tried.join(shuffled(hit), KEYS, "left").where("target IS NULL OR target <> path")
    return met.select(*KEYS, "target", F.when(F.col("target").isNull(), F.col("external")).alias("external")).distinct()


# -- specs that are paths

#: (Fixed values.) Specs of these languages: what is none at all, what lies outside, and what is cut off.
PATH_RULES = {
    "sql": (None, r"^(?:/|.:)", None),
    "shell": (None, r"[$`]|^/", None),
    "html": ("^#", r"(?i)^(?:https?://|//|data:|mailto:|tel:|javascript:|blob:|about:)", "[#?].*$"),
    "css": (None, r"://|^//|^(?:sass|data):", None),
    "json": ("^#", r"^[a-z][a-z0-9+.-]*://|^//", "#.*$"),
    "yaml": ("^#", r"^[a-z][a-z0-9+.-]*://|^//", "#.*$"),
    "asm": (None, r"[$`]|^/", None),
    "kconfig": (None, r"[$`]|^/", None),
    "devicetree": (None, r"[$`]|^/", None),
    "make": (None, r"[$`]|^/", None),
}


def path_imports(specs: DataFrame, paths: DataFrame, language: str) -> DataFrame:
    """Specs that name a file from the importing file's folder."""
    none, outside, cut = PATH_RULES[language]
    spec = F.col("spec")
    rows = specs.where(spec != "") if none is None else specs.where((spec != "") & ~spec.rlike(none))
    clean = F.regexp_replace(spec, cut, "") if cut else spec
    rows = rows.select(*KEYS, F.when(~spec.rlike(outside), beside(clean)).alias("_target"))  # worked out once
    target = F.col("_target")
    tried = F.array(target)
    if language == "css":  # a name without an ending may be a sheet or a partial
        name, base = F.substring_index(target, "/", -1), F.regexp_replace(target, "[^/]*$", "")
        whole = [F.concat(target, F.lit(".css")), F.concat(target, F.lit(".scss"))]
        parts = [F.concat(base, F.lit("_"), name, F.lit(e)) for e in (".scss", ".css")]
        tried = F.when(name.contains("."), tried).otherwise(F.array(target, *whole, *parts))
    return first_file(rows.select(*KEYS, tried.alias("candidates"), spec.alias("external")), paths)


def ruby_imports(specs: DataFrame, paths: DataFrame) -> DataFrame:
    """form require_relative: beside the file; others: from the root, else the gem that the spec begins with."""
    near = F.col("form") == "require_relative"
    rooted = F.when(F.endswith("spec", F.lit(".rb")), F.col("spec")).otherwise(F.concat("spec", F.lit(".rb")))
    local = beside(F.col("spec"))
    tried = F.when(near, F.array(F.concat(local, F.lit(".rb")), local)).otherwise(F.array(rooted))
    gem = F.when(~near, F.lower(F.substring_index("spec", "/", 1)))
    return first_file(specs.select(*KEYS, tried.alias("candidates"), gem.alias("external")), paths)


# -- specs that are names


def psr4_prefixes(files: DataFrame) -> DataFrame:
    """(repo, prefix, dir) of the autoload sections of each composer.json at a root; of several folders the first."""
    section = "struct<`psr-4`: map<string, variant>>"
    doc = F.from_json("text", f"autoload {section}, `autoload-dev` {section}")
    roots = files.where("path = 'composer.json'").select("repo", doc.alias("d"))
    entries = [
        roots.select("repo", F.lit(i).alias("at"), F.explode(F.col("d")[s]["psr-4"]).alias("prefix", "v"))
        for i, s in enumerate(("autoload", "autoload-dev"))
    ]
    one = F.coalesce(F.try_variant_get("v", "$[0]", "string"), F.try_variant_get("v", "$", "string"))
    rows = entries[0].unionAll(entries[1]).select("repo", "prefix", "at", one.alias("dir")).where("dir <> ''")
    return rows.groupBy("repo", "prefix").agg(F.max_by("dir", "at").alias("dir"))


def php_imports(specs: DataFrame, paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """form use: the longest PSR-4 prefix; others are paths beside the file."""
    uses = specs.where("form = 'use'").join(shuffled(prefixes), "repo", "left")
    fits = F.when(F.startswith("spec", F.col("prefix")), F.struct(F.length("prefix").alias("n"), "prefix", "dir"))
    best = uses.groupBy(*KEYS).agg(F.max(fits).alias("p"))
    rest = F.replace(F.substring(F.col("spec"), F.col("p.n") + 1, F.length("spec")), F.lit("\\"), F.lit("/"))
    named = best.select(*KEYS, F.array(joined(F.col("p.dir"), F.concat(rest, F.lit(".php")))).alias("candidates"))
    plain = specs.where("form <> 'use' AND spec <> ''")
    local = F.when(F.startswith("spec", F.lit("/")), F.array(nothing())).otherwise(F.array(beside(F.col("spec"))))
    both = named.unionAll(plain.select(*KEYS, local))
    return first_file(both.withColumn("external", F.col("spec")), paths)


def dart_packages(files: DataFrame) -> DataFrame:
    """(repo, dir, package) of each pubspec.yaml."""
    name = F.regexp_extract("text", r"(?m)^name:\s*[\"']?([A-Za-z0-9_]+)", 1)
    own = files.where(F.substring_index("path", "/", -1) == "pubspec.yaml")
    return own.select("repo", folder(F.col("path")).alias("dir"), name.alias("package")).where("package <> ''")


def dart_imports(specs: DataFrame, paths: DataFrame, packages: DataFrame) -> DataFrame:
    """package: specs by the pubspec that has the name, others beside the file; dart: specs are external."""
    inside = F.regexp_extract("spec", "^package:([^/]*)", 1)
    rest = F.regexp_replace("spec", "^package:[^/]*/?", "")
    own = packages.groupBy("repo", "package").agg(F.max("dir").alias("dir"))
    met = specs.withColumn("package", F.nullif(inside, F.lit(""))).join(shuffled(own), ["repo", "package"], "left")
    tried = F.when(F.startswith("spec", F.lit("dart:")), F.array(nothing())).when(
        F.col("package").isNotNull(), F.array(F.when(F.col("dir").isNotNull(), joined(F.col("dir"), F.concat(F.lit("lib/"), rest))))
    ).otherwise(F.array(beside(F.col("spec"))))
    outside = F.coalesce("package", F.when(F.startswith("spec", F.lit("dart:")), F.col("spec")))
    return first_file(met.select(*KEYS, tried.alias("candidates"), outside.alias("external")), paths)


def swift_modules(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each Package.swift at a root: (repo, module, dir) of its targets, (repo, module, package) of its products.

    A product's package is named by its reference, and by the address and the short name of the package referred to.
    """
    roots = files.where("path = 'Package.swift'").select("repo", "text")
    target = r"\.(?:target|executableTarget|testTarget|systemLibrary|plugin)\s*\(\s*name\s*:\s*\"([^\"]+)\"(?:[^)]*?path\s*:\s*\"([^\"]+)\")?"
    pairs = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(target), 1).alias("m"), F.regexp_extract_all("text", F.lit(target), 2).alias("p")
    )
    local = roots.select("repo", F.explode(pairs).alias("x"))
    where = F.when(F.coalesce("x.p", F.lit("")) != "", F.btrim(F.col("x.p"), F.lit("/"))).otherwise(F.concat(F.lit("Sources/"), "x.m"))
    modules = local.select("repo", F.col("x.m").alias("module"), where.alias("dir"))
    product = r"\.product\s*\(\s*name\s*:\s*\"([^\"]+)\"\s*,\s*package\s*:\s*\"([^\"]+)\""
    used = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(product), 1).alias("m"), F.regexp_extract_all("text", F.lit(product), 2).alias("p")
    )
    products = roots.select("repo", F.explode(used).alias("x")).select("repo", F.col("x.m").alias("module"), F.lower("x.p").alias("ref"))
    package = r"\.package\s*\(\s*(?:name\s*:\s*\"([^\"]*)\"\s*,\s*)?url\s*:\s*\"([^\"]+)\""
    known = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(package), 1).alias("n"), F.regexp_extract_all("text", F.lit(package), 2).alias("u")
    )
    url = F.lower(F.regexp_replace(F.regexp_replace("x.u", "/+$", ""), r"\.git$", ""))
    names = F.array_distinct(F.array_compact(F.array(F.nullif(F.lower("x.n"), F.lit("")), F.substring_index(url, "/", -1), url)))
    aliases = roots.select("repo", F.explode(known).alias("x")).select("repo", names.alias("names"))
    by_ref = aliases.select("repo", F.explode("names").alias("ref"), "names")
    met = products.join(shuffled(by_ref), ["repo", "ref"], "left")
    named = met.select("repo", "module", F.explode(F.coalesce("names", F.array("ref"))).alias("package")).distinct()
    return modules, named


def swift_imports(specs: DataFrame, paths: DataFrame, modules: DataFrame, products: DataFrame) -> DataFrame:
    """A target of the package: the file of its name, else its first one; a product: the packages it may come from."""
    own = modules.groupBy("repo", "module").agg(F.max("dir").alias("dir"))
    # a file lies in every folder above it, so targets meet their files on equal folders
    swift = paths.where(F.endswith("path", F.lit(".swift")) & F.contains("path", F.lit("/")))
    below = swift.select("repo", F.col("path").alias("target"), F.explode(above("path")).alias("dir"))
    stem = F.regexp_extract("target", r"([^/]*)\.swift$", 1)
    best = own.join(shuffled(below), ["repo", "dir"]).groupBy("repo", "module").agg(
        F.min(F.struct((stem != F.col("module")).alias("other"), "target")).alias("t")
    )
    files = best.select("repo", F.col("module").alias("spec"), "t.target")
    local = own.select("repo", F.col("module").alias("spec"), F.lit(True).alias("local"))
    external = products.select("repo", F.col("module").alias("spec"), "package")
    met = specs.select(*KEYS).distinct().join(shuffled(local), ["repo", "spec"], "left").join(shuffled(files), ["repo", "spec"], "left")
    met = met.join(shuffled(external), ["repo", "spec"], "left")
    named = F.when(F.col("local"), F.col("spec")).otherwise(F.coalesce("package", "spec"))
    out = met.select(*KEYS, "target", F.when(F.col("target").isNull(), named).alias("external"))
    return out.where("target IS NULL OR target <> path").distinct()


def rust_crates(files: DataFrame) -> DataFrame:
    """(repo, dir, crate) of each Cargo.toml with a package."""
    name = F.regexp_extract("text", r"(?ms)^\[package\][^\[]*?^name\s*=\s*\"([^\"]+)\"", 1)
    own = files.where(F.substring_index("path", "/", -1) == "Cargo.toml")
    return own.select("repo", folder(F.col("path")).alias("dir"), name.alias("crate")).where("crate <> ''")


def rust_imports(specs: DataFrame, paths: DataFrame, crates: DataFrame) -> DataFrame:
    """crate, self, super or a crate of the repository, then the longest module path that is a file."""
    src = F.concat_ws("/", F.nullif(F.col("dir"), F.lit("")), F.lit("src"))
    # the crate of a file is the one of the deepest folder above it
    at = specs.select("repo", "path").distinct().select("repo", "path", F.explode(above("path")).alias("dir")).join(shuffled(crates), ["repo", "dir"])
    mine = at.groupBy("repo", "path").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    met = specs.select(*KEYS).distinct().join(shuffled(mine), ["repo", "path"], "left").withColumn("dir", F.coalesce("dir", F.lit("")))
    segments = F.filter(F.transform(F.split("spec", "::"), lambda x: F.trim(x)), lambda s: s != "")
    cut = met.withColumn("s", segments).where("size(s) > 0").withColumn("head", F.get("s", F.lit(0))).withColumn("src", src)
    named = crates.select("repo", F.explode(F.array_distinct(F.array("crate", F.replace("crate", F.lit("-"), F.lit("_"))))).alias("head"), F.col("dir").alias("other"))
    named = named.groupBy("repo", "head").agg(F.max("other").alias("other"))
    cut = cut.join(shuffled(named), ["repo", "head"], "left")
    inside = F.regexp_replace(F.substring(F.col("path"), F.length("src") + 2, F.length("path")), r"\.rs$", "")
    module = F.when(~F.startswith("path", F.concat("src", F.lit("/"))) | inside.isin("lib", "main"), F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(inside, "/mod$", ""), "/")
    )
    supers = F.coalesce(F.nullif(F.array_position(F.transform("s", lambda x: x == "super"), False) - 1, F.lit(-1)), F.size("s")).cast("int")
    tail = lambda n: F.slice("s", n + 1, F.greatest(F.size("s"), F.lit(1)))
    up = F.concat(F.slice(F.col("module"), F.lit(1), F.greatest(F.size("module") - supers, F.lit(0))), tail(supers))
    rest = (
        F.when(F.col("head") == "self", F.concat("module", tail(F.lit(1))))
        .when(F.col("head") == "super", F.when(supers <= F.size("module"), up))
        .when((F.col("head") == "crate") | F.col("other").isNotNull(), tail(F.lit(1)))
    )
    base = F.when(F.col("head").isin("crate", "self", "super"), F.col("src")).otherwise(
        F.concat_ws("/", F.nullif(F.col("other"), F.lit("")), F.lit("src"))
    )
    ready = cut.withColumn("module", module).withColumn("rest", rest).withColumn("base", base)
    lengths = F.reverse(F.sequence(F.lit(0), F.size("rest")))
    path = lambda n: F.concat_ws("/", F.concat(F.array("base"), F.slice("rest", F.lit(1), n)))
    tried = F.flatten(F.transform(lengths, lambda n: F.array(*(F.concat(path(n), F.lit(e)) for e in (".rs", "/mod.rs", "/lib.rs")))))
    tried = F.when(F.col("rest").isNotNull(), F.concat(tried, F.array(F.concat("base", F.lit("/main.rs"))))).otherwise(F.array(nothing()))
    local = F.col("head").isin("crate", "self", "super") | F.col("other").isNotNull()
    outside = F.when(~local, F.replace(F.lower("head"), F.lit("_"), F.lit("-")))
    return first_file(ready.select(*KEYS, tried.alias("candidates"), outside.alias("external")), paths)


# -- includes


def include_roots(files: DataFrame) -> DataFrame:
    """(repo, root, at) that compile_commands.json gives: -I and -isystem of its commands, in their order."""
    doc = F.from_json("text", "array<struct<arguments: array<string>, command: string>>")
    own = files.where(F.substring_index("path", "/", -1) == "compile_commands.json")
    each = own.select("repo", F.posexplode(doc).alias("n", "e"))
    words = F.coalesce("e.arguments", F.split("e.command", r"\s+"))
    args = each.select("repo", "n", F.posexplode(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "x"))
    glued = F.regexp_extract("x.a", "^(?:-isystem|-I)(.+)$", 1)
    root = F.when(F.col("x.a").isin("-I", "-isystem"), F.col("x.b")).otherwise(F.nullif(glued, F.lit("")))
    rows = args.select("repo", F.struct("n", "k").alias("at"), F.regexp_replace(root, "(?<=.)/+$", "").alias("root"))
    local = rows.where("root IS NOT NULL AND root NOT LIKE '/%'")
    return local.groupBy("repo", "root").agg(F.min("at").alias("at"))


def _suffixes(paths: DataFrame, longest: Column) -> DataFrame:
    """(repo, name, path): each path under its last 1, 2, ... segments, up to `longest` of them."""
    n = F.size(F.split("path", "/"))
    tails = F.transform(F.sequence(F.lit(1), F.least(n, longest)), lambda k: F.array_join(F.slice(F.split("path", "/"), n - k + 1, k), "/"))
    return paths.select("repo", "path", F.explode(tails).alias("name"))


def c_imports(specs: DataFrame, paths: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """form include: beside the file, else the only file of that name; form system_include: by the include roots, else the
    only path that ends with the spec, else external. Also (repo, path, spec, target) of specs that several paths end with,
    at most 16 of each in order of their names."""
    own = paths.select("repo", "path").distinct()
    quoted, angle = (specs.where(F.col("form") == f) for f in ("include", "system_include"))
    near = quoted.select(*KEYS, F.array(beside(F.col("spec"))).alias("candidates"), F.lit("").alias("external"))
    first = first_file(near, own)
    left = first.where("target IS NULL").select(*KEYS, F.array(F.substring_index("spec", "/", -1)).alias("names"), nothing().alias("external"))
    by_name = unique_file(left, own.select("repo", F.substring_index("path", "/", -1).alias("name"), "path")).where("target IS NOT NULL")
    ordered = roots.groupBy("repo").agg(F.transform(F.sort_array(F.collect_set(F.struct("at", "root"))), lambda x: x["root"]).alias("roots"))
    rooted = angle.join(shuffled(ordered), "repo", "left").select(
        *KEYS, F.coalesce(F.transform("roots", lambda r: F.concat(r, F.lit("/"), F.col("spec"))), F.array(nothing())).alias("candidates"), F.lit("").alias("external")
    )
    exact = first_file(rooted, own)
    open_ = exact.where("target IS NULL").select(*KEYS)
    # only as many segments as the longest spec has
    longest = open_.select("repo", F.size(F.split("spec", "/")).alias("n")).groupBy("repo").agg(F.max("n").alias("n"))
    tails = _suffixes(own.join(shuffled(longest), "repo").select("repo", "path", "n"), F.col("n"))
    met = open_.join(shuffled(tails.select("repo", F.col("name").alias("spec"), F.col("path").alias("target"))), ["repo", "spec"])
    counted = met.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("target").alias("target"))
    joined_ = open_.join(shuffled(counted), KEYS, "left")
    one = F.when(F.col("n") == 1, F.col("target"))
    by_suffix = joined_.select(*KEYS, one.alias("target"), F.when(one.isNull(), F.col("spec")).alias("external"))
    several = met.join(shuffled(counted.where("n > 1").select(*KEYS)), KEYS).groupBy(*KEYS).agg(
        F.slice(F.sort_array(F.collect_set("target")), 1, 16).alias("t")
    )
    found = first.where("target IS NOT NULL").unionByName(by_name).unionByName(exact.where("target IS NOT NULL")).unionByName(by_suffix)
    return found.where("target IS NULL OR target <> path"), several.select(*KEYS, F.explode("t").alias("target"))


def objc_imports(specs: DataFrame, paths: DataFrame) -> DataFrame:
    """As C without include roots, but by the last segment alone; form module_import is external by its first part, and a
    system include is external even where a file answers it (two rows then)."""
    own = paths.select("repo", "path").distinct()
    index = own.select("repo", F.substring_index("path", "/", -1).alias("name"), "path")
    local, system = (specs.where(F.col("form") == f) for f in ("include", "system_include"))
    name = F.array(F.substring_index("spec", "/", -1)).alias("names")
    near = first_file(local.select(*KEYS, F.array(beside(F.col("spec"))).alias("candidates"), F.lit("").alias("external")), own)
    rest = near.where("target IS NULL").unionByName(system.select(*KEYS, nothing().alias("target"), nothing().alias("external")))
    by_name = unique_file(rest.select(*KEYS, name, nothing().alias("external")), index).where("target IS NOT NULL")
    modules = specs.where("form = 'module_import'").select(*KEYS, nothing().alias("target"), F.substring_index("spec", ".", 1).alias("external"))
    outside = system.select(*KEYS, nothing().alias("target"), F.col("spec").alias("external"))
    return near.where("target IS NOT NULL").unionByName(by_name).unionByName(modules).unionByName(outside).distinct()


# -- names that are folders


def clojure_imports(specs: DataFrame, paths: DataFrame) -> DataFrame:
    """A namespace a.b-c is the first path that ends with a/b_c and .clj, .cljs, .cljc or .cljr, in that order."""
    endings = [".clj", ".cljs", ".cljc", ".cljr"]
    rel = F.translate("spec", ".-", "/_")
    tried = specs.select(*KEYS, F.posexplode(F.array(*(F.concat(rel, F.lit(e)) for e in endings))).alias("prio", "name"))
    own = paths.where(F.col("path").rlike(r"\.clj[scr]?$")).select("repo", "path").distinct()
    tails = _suffixes(own, F.size(F.split("path", "/"))).withColumnRenamed("path", "target")
    best = tried.join(shuffled(tails), ["repo", "name"]).groupBy(*KEYS).agg(F.min(F.struct("prio", "target")).alias("t"))
    met = specs.select(*KEYS).distinct().join(shuffled(best), KEYS, "left")
    return met.select(*KEYS, F.col("t.target").alias("target"), F.when(F.col("t").isNull(), F.col("spec")).alias("external"))


def cobol_imports(specs: DataFrame, paths: DataFrame) -> DataFrame:
    """A copybook is the first file with its name as stem, in any case."""
    stem = F.lower(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))
    first = paths.groupBy("repo", stem.alias("name")).agg(F.min("path").alias("target"))
    met = specs.select(*KEYS, F.lower("spec").alias("name")).distinct().join(shuffled(first), ["repo", "name"], "left")
    target = F.when(F.col("target") != F.col("path"), F.col("target"))
    return met.select(*KEYS, target.alias("target"), F.when(target.isNull(), F.col("spec")).alias("external"))


def cfml_imports(specs: DataFrame, paths: DataFrame) -> DataFrame:
    """forms cfinclude and cfimport are paths from the file's folder or the root (a folder of tags gives its files);
    others are dotted names of components, `.*` of all in a folder, else external by their first part in lower case."""
    own = paths.select("repo", "path").distinct()
    is_path = F.col("form").isin("cfinclude", "cfimport")
    clean = F.regexp_replace("spec", "^/+", "")
    rooted = F.startswith("spec", F.lit("/"))
    places = F.when(rooted, F.array(normal_path(clean))).otherwise(F.array(beside(clean), normal_path(clean)))
    dotted = F.translate(F.regexp_replace("spec", r"\.\*$", ""), ".", "/")
    many = F.endswith("spec", F.lit(".*"))
    component = F.array(F.concat(dotted, F.lit(".cfc")), beside(F.concat(dotted, F.lit(".cfc"))))
    outside = F.when(~is_path, F.lower(F.substring_index("spec", ".", 1)))
    single = specs.where(~many).select(*KEYS, F.when(is_path, places).otherwise(component).alias("candidates"), outside.alias("external"))
    files = first_file(single, own)
    children = own.where(F.col("path").rlike(r"\.cf[cm]$")).select("repo", folder(F.col("path")).alias("dir"), F.col("path").alias("target"))
    open_ = specs.join(shuffled(files.where("target IS NOT NULL").select(*KEYS)), KEYS, "left_anti").where(many | (F.col("form") == "cfimport"))
    dirs = F.when(is_path, places).otherwise(F.array(dotted, beside(dotted)))
    spread = open_.select(*KEYS, "form", F.posexplode(dirs).alias("prio", "dir")).join(shuffled(children), ["repo", "dir"])
    spread = spread.where((F.col("form") == "cfimport") | F.endswith("target", F.lit(".cfc")))
    least = spread.groupBy(*KEYS).agg(F.min("prio").alias("prio"))
    listed = spread.join(shuffled(least), [*KEYS, "prio"]).select(*KEYS, "target", nothing().alias("external"))
    missed = specs.where(many).select(*KEYS, outside.alias("external")).join(shuffled(least.select(*KEYS)), KEYS, "left_anti")
    return files.unionByName(listed).unionByName(missed.select(*KEYS, nothing().alias("target"), "external")).where("target IS NULL OR target <> path").distinct()


# -- TypeScript and JavaScript

#: What a spec may lack, in order (fixed values).
ENDINGS = [".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs"]
INDEXES = ["index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs", "index.cjs"]


def _script_files(target: Column) -> Column:
    """The files that a target without or with its ending may be."""
    swapped = F.when(F.endswith(target, F.lit(".js")), F.regexp_replace(target, r"\.js$", ""))
    return F.array(
        target,
        *(F.concat(swapped, F.lit(e)) for e in (".ts", ".tsx")),
        *(F.concat(target, F.lit(e)) for e in ENDINGS),
        *(F.concat(target, F.lit("/"), F.lit(i)) for i in INDEXES),
    )


def tsconfigs(files: DataFrame) -> DataFrame:
    """(repo, path, dir, base, paths array of (alias, targets)) of each tsconfig*.json and jsconfig.json.

    Comments and commas at the ends of lists may stand in them. What a config extends is merged below its own values; a
    chain that comes back to itself ends there. The chains of all repositories are followed together, a step a round.
    """
    name = F.substring_index("path", "/", -1)
    own = files.where(name.rlike(r"^(?:tsconfig.*\.json|jsconfig\.json)$"))
    # strings stay as they are, comments outside of them go
    plain = F.regexp_replace("text", r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*(?s:.*?)\*/', "$1")
    plain = F.regexp_replace(plain, r",(\s*[}\]])", "$1")
    doc = F.from_json(plain, "extends variant, compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>")
    parsed = own.select("repo", "path", folder(F.col("path")).alias("dir"), doc.alias("d"))
    many = F.try_variant_get("d.extends", "$", "array<string>")
    one = F.array_compact(F.array(F.try_variant_get("d.extends", "$", "string")))
    raw = F.filter(F.coalesce(many, one, F.array().cast("array<string>")), lambda x: x.rlike("^(?:[.]{1,2})?/"))
    parent = F.transform(raw, lambda x: joined(F.col("dir"), x))
    ends = F.transform(parent, lambda x: F.array(x, F.concat(x, F.lit(".json")), F.concat(x, F.lit("/tsconfig.json"))))
    rows = parsed.select(
        "repo", "path", "dir", F.col("d.compilerOptions.baseUrl").alias("base"),
        F.map_entries("d.compilerOptions.paths").alias("paths"), ends.alias("parents"),
    )

    rows = materialize(rows)
    tried = rows.select("repo", F.col("path").alias("cur"), F.posexplode("parents").alias("i", "tried"))
    tried = tried.select("repo", "cur", "i", F.posexplode("tried").alias("j", "up"))
    there = rows.select("repo", F.col("path").alias("up"))
    step = tried.join(shuffled(there), ["repo", "up"]).groupBy("repo", "cur", "i").agg(F.min_by("up", "j").alias("up"))
    step = materialize(step)
    # what a config is made of, in the order in which it counts: what it extends, from the first to the last, then itself
    front = rows.select("repo", F.col("path").alias("root"), F.col("path").alias("cur"), F.array().cast("array<int>").alias("at"), F.array("path").alias("seen"))
    parts = [front]
    while True:
        met = front.join(shuffled(step), ["repo", "cur"]).where(~F.array_contains("seen", F.col("up")))
        front = materialize(met.select("repo", "root", F.col("up").alias("cur"), F.concat("at", F.array("i")).alias("at"), F.concat("seen", F.array("up")).alias("seen")))
        if front.isEmpty():
            break
        parts.append(front)
    itself = F.lit((1 << 31) - 1)
    every = reduce(DataFrame.unionAll, parts).select("repo", "root", "cur", F.concat("at", F.array(itself)).alias("at"))
    said = every.join(shuffled(rows.select("repo", F.col("path").alias("cur"), "base", "paths")), ["repo", "cur"])
    bases = said.groupBy("repo", "root").agg(F.max_by("base", F.when(F.col("base").isNotNull(), F.col("at"))).alias("base"))
    each = said.select("repo", "root", "at", F.posexplode("paths").alias("n", "e"))
    kept = each.groupBy("repo", "root", "e.key").agg(F.max_by("e.value", "at").alias("value"), F.min(F.struct("at", "n")).alias("place"))
    listed = kept.groupBy("repo", "root").agg(F.array_sort(F.collect_list(F.struct("place", "key", "value"))).alias("all"))
    merged = bases.join(shuffled(listed), ["repo", "root"], "left").withColumnRenamed("root", "path")
    pair = F.transform(F.coalesce("all", F.array().cast("array<struct<place:struct<at:array<int>,n:int>,key:string,value:array<string>>>")), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    return rows.select("repo", "path", "dir").join(shuffled(merged), ["repo", "path"]).select("repo", "path", "dir", F.coalesce("base", F.lit(".")).alias("base"), pair.alias("paths"))


def script_imports(specs: DataFrame, paths: DataFrame, configs: DataFrame) -> DataFrame:
    """Relative specs beside the file, others by the aliases of the deepest config above it (of equals one with aliases)."""
    relative = F.col("spec").rlike(r"^\.{1,2}(?:/|$)")
    local = specs.where(relative).select(*KEYS, beside(F.col("spec")).alias("t"))
    near = local.select(*KEYS, _script_files(F.col("t")).alias("candidates"), nothing().alias("external"))
    importers = specs.where(~relative).select("repo", "path").distinct()
    dirs = importers.select("repo", "path", F.explode(above("path")).alias("dir"))
    c = configs.select("repo", "dir", "base", "paths", F.col("path").alias("config"))
    rank = F.struct(F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))).alias("depth"), (F.size("paths") > 0).alias("has"))
    ranked = dirs.join(shuffled(c), ["repo", "dir"]).withColumn("rank", rank)
    top = ranked.groupBy("repo", "path").agg(F.max("rank").alias("rank"))
    governing = ranked.join(shuffled(top), ["repo", "path", "rank"]).groupBy("repo", "path").agg(F.min(F.struct("config")).alias("g"))
    governed = governing.join(shuffled(configs.select("repo", F.col("path").alias("config"), "dir", "base", "paths")),
                              (governing.repo == configs.repo) & (F.col("g.config") == F.col("config"))).select(governing.repo, governing.path, "dir", "base", "paths")
    met = specs.where(~relative).join(shuffled(governed), ["repo", "path"])
    entry = met.select(*KEYS, joined(F.col("dir"), F.col("base")).alias("root"), F.posexplode("paths").alias("n", "e"))
    star = F.contains("e.key", F.lit("*"))
    pre, post = F.substring_index("e.key", "*", 1), F.regexp_replace("e.key", r"^[^*]*\*", "")
    fits = F.when(star, F.startswith("spec", pre) & F.endswith("spec", post) & (F.length("spec") >= F.length(pre) + F.length(post))).otherwise(F.col("spec") == F.col("e.key"))
    hole = F.substring(F.col("spec"), F.length(pre) + 1, F.length("spec") - F.length(pre) - F.length(post))
    fitted = entry.where(fits).select(*KEYS, "root", "n", F.when(star, hole).alias("hole"), F.posexplode("e.value").alias("k", "to"))
    target = joined(F.col("root"), F.when(F.col("hole").isNotNull(), F.concat(F.substring_index("to", "*", 1), "hole", F.regexp_replace("to", r"^[^*]*\*?", ""))).otherwise(F.col("to")))
    placed = fitted.select(*KEYS, "n", "k", target.alias("t"))
    listed = placed.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("n", "k", "t"))).alias("all"))
    aliased = listed.select(*KEYS, F.flatten(F.transform("all", lambda x: _script_files(x["t"]))).alias("candidates"), nothing().alias("external"))
    return first_file(near.unionAll(aliased), paths)


# -- names with declared dependencies


def declared_groups(specs: DataFrame, declared: DataFrame) -> DataFrame:
    """(repo, path, spec, external, prefix): the declared coordinate group:name whose group is the longest prefix of a dotted
    spec (the first of equals), else its first three parts."""
    parts = F.split(F.regexp_replace("spec", r"\.\*$", ""), r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    each = specs.select(*KEYS, F.explode(heads).alias("group"))
    known = declared.where("package LIKE '%:%'").select("repo", F.substring_index("package", ":", 1).alias("group"), "package")
    first = known.groupBy("repo", "group").agg(F.min("package").alias("package"))
    best = each.join(shuffled(first), ["repo", "group"]).groupBy(*KEYS).agg(F.max_by("package", F.length("group")).alias("package"))
    short = F.array_join(F.slice(parts, 1, 3), ".")
    met = specs.select(*KEYS).distinct().join(shuffled(best), KEYS, "left")
    return met.select(*KEYS, F.coalesce("package", short).alias("external"), F.col("package").isNotNull().alias("prefix"))


def class_imports(specs: DataFrame, classes: DataFrame, declared: DataFrame) -> DataFrame:
    """Java and Kotlin: (repo, path, spec, target, external, prefix).

    classes are (repo, path, package, name). form static: the class of the member; form wildcard: all files of the
    package; others: the class, else the class around it. A name that several files declare answers nothing. What is
    left goes to the declared groups.
    """
    full = F.concat_ws(".", F.nullif(F.col("package"), F.lit("")), F.col("name"))
    index = classes.select("repo", full.alias("name"), "path").distinct()
    parent = F.regexp_replace("q", r"\.[^.]*$", "")
    q = F.when(F.col("form") == "static", F.regexp_replace("spec", r"\.[^.]*$", "")).otherwise(F.col("spec"))
    plain = specs.where("form <> 'wildcard'").select(*KEYS, q.alias("q"))
    single = unique_file(plain.select(*KEYS, F.array("q", parent).alias("names"), F.lit("").alias("external")), index)
    single = materialize(single.where("target IS NOT NULL").select(*KEYS, "target"))  # read twice
    inside = classes.select("repo", F.col("package").alias("q"), F.col("path").alias("target")).where("q <> ''").distinct()
    wild = specs.where("form = 'wildcard'").select(*KEYS, F.regexp_replace("spec", r"\.\*$", "").alias("q"))
    every = materialize(wild.join(shuffled(inside), ["repo", "q"]).select(*KEYS, "target"))
    found = single.unionAll(every)
    hit = found.select(*KEYS).distinct()
    # a class that imports itself answers its spec, without a row
    own = index.groupBy("repo", "name").agg(F.min("path").alias("path"), F.max("path").alias("last")).where("path = last")
    selfish = plain.join(shuffled(own.select("repo", F.col("name").alias("q"), "path")), ["repo", "q", "path"]).select(*KEYS)
    rest = declared_groups(specs.select(*KEYS).distinct().join(shuffled(hit.unionAll(selfish)), KEYS, "left_anti"), declared)
    out = found.where("target <> path").select(*KEYS, "target", nothing().alias("external"), F.lit(None).cast("boolean").alias("prefix"))
    return out.unionByName(rest.withColumn("target", nothing())).distinct()


def python_roots(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(repo, root): folders that modules are counted from: those pyproject.toml names, src and tests if they exist, the root."""
    import pandas as pd

    def run(frames):
        import tomllib

        for f in frames:
            out = []
            for repo, text in zip(f["repo"], f["text"]):
                try:
                    tool = tomllib.loads(text or "").get("tool", {})
                    named = list((tool.get("setuptools", {}).get("packages") or {}).get("find", {}).get("where") or [])
                    for t in (tool.get("hatch", {}).get("build", {}).get("targets") or {}).values():
                        named += [p.rpartition("/")[0] for p in t.get("packages") or [] if "/" in p]
                    named += [p["from"] for p in tool.get("poetry", {}).get("packages") or [] if p.get("from")]
                except (tomllib.TOMLDecodeError, AttributeError, TypeError, KeyError):
                    named = []
                out += [(repo, str(n).strip("/")) for n in named]
            yield pd.DataFrame(out, columns=["repo", "root"])

    kind = dict(files.dtypes)["repo"]
    named = files.where("path = 'pyproject.toml'").select("repo", "text").mapInPandas(run, f"repo {kind}, root string")
    usual = paths.select("repo", F.regexp_extract("path", "^(src|tests)/", 1).alias("root"))
    return named.unionAll(usual).unionAll(paths.select("repo", F.lit(""))).distinct()
