"""What resolvers look names up in, for all repositories together: module paths, source roots, symbols by their files, item facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (Fixed values.) Folders that Java packages are counted from.
JAVA_ROOTS = ["src/main/java", "src/test/java", "src/main/kotlin"]
#: (Fixed values.) Kinds of items that a name stands for in C++ and in Objective-C.
CPP_KINDS = ["class", "struct", "union", "enum", "function"]
OBJC_KINDS = ["class_interface", "class_implementation", "protocol", "function"]
OBJC_CATEGORIES = ["category", "category_impl"]


def go_modules(files: DataFrame) -> DataFrame:
    """(repo, module, dir): the path that the go.mod at the top of a repository names, or else the one least deep.

    Of equally deep ones the first by name is taken. Where it names no module, the repository has none.
    """
    mods = files.where((F.col("path") == "go.mod") | F.endswith("path", F.lit("/go.mod")))
    depth = F.size(F.split("path", "/"))
    first = mods.groupBy("repo").agg(F.min_by(F.struct("path", "text"), F.struct(depth, "path")).alias("m"))
    module = F.regexp_extract("m.text", r"(?m)^\s*module\s+(\S+)", 1)
    return first.select("repo", module.alias("module"), F.regexp_replace("m.path", r"/?go\.mod$", "").alias("dir")).where("module <> ''")


def java_roots(files: DataFrame) -> DataFrame:
    """(repo, root): the folders of Java files that end in one of JAVA_ROOTS, the deepest of each kind."""

    def root(marker: str) -> Column:
        inner = F.regexp_extract("path", rf"^(.*/{marker})/", 1)
        return F.when(inner != "", F.regexp_replace(inner, "^/", "")).when(F.startswith("path", F.lit(marker + "/")), marker)

    found = F.explode(F.array_compact(F.array(*map(root, JAVA_ROOTS))))
    return files.where("language = 'java'").select("repo", found.alias("root")).distinct()


def symbol_index(items: DataFrame, language: str) -> DataFrame:
    """(name, path) of the files that define a name of `language` (cpp or objective-c) at their top: items are (language,
    path, kind, name, parent). A category stands for itself and for the class that it adds to."""
    top = items.where((F.col("language") == language) & F.col("parent").isNull())
    if language == "cpp":
        return top.where(F.col("kind").isin(CPP_KINDS)).select("name", "path").distinct()
    host = F.when(F.col("kind").isin(OBJC_CATEGORIES), F.array("name", F.substring_index("name", "(", 1))).otherwise(F.array("name"))
    return top.where(F.col("kind").isin(OBJC_KINDS + OBJC_CATEGORIES)).select(F.explode(host).alias("name"), "path").distinct()


ITEM = "path string, kind string, name string, is_pub boolean, is_async boolean, attributes array<string>"


def item_facets(lines: DataFrame) -> DataFrame:
    """(facet, value, n) of JSON lines (value), one item each: totals, public and asynchronous ones, kinds, top folders, attributes.

    Lines that are no items are counted as malformed, blank ones not at all.
    """
    said = lines.where(F.trim("value") != "")
    read = said.select(F.from_json("value", ITEM + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x"))
    bad = F.col("x").isNull() | F.col("x._bad").isNotNull()

    def pair(facet: str, value: Column) -> Column:
        return F.struct(F.lit(facet).alias("facet"), value.alias("value"))

    folder = F.when(F.contains("x.path", F.lit("/")), F.substring_index("x.path", "/", 1)).otherwise("(root)")
    good = F.array_compact(
        F.array(
            pair("total", F.lit("items")),
            pair("kind", F.coalesce("x.kind", F.lit("(unknown)"))),
            F.when(F.col("x.is_pub"), pair("total", F.lit("public"))),
            F.when(F.col("x.is_async"), pair("total", F.lit("async"))),
            F.when(F.col("x.path").isNotNull(), pair("folder", folder)),
        )
    )
    named = F.transform(F.coalesce("x.attributes", F.array().cast("array<string>")), lambda a: pair("attribute", a))
    each = read.select(F.explode(F.when(bad, F.array(pair("total", F.lit("malformed")))).otherwise(F.concat(good, named))).alias("f"))
    return each.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
