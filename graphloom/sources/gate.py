"""Whether a bundle may be released, and where to begin in it.

`check` counts again what a bundle's manifest claims, from its graph and its tables, and gives a row for each check, passed or
not. `orient` says what classes and predicates its graph has. Both read the graph once and are joins and aggregates alone.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import constraints as cs
from graphloom.sources import artifacts as ar
from graphloom.sources import bundle as b

SCHEMA = "check string, name string, found double, bound double, ok boolean"


@dataclass(frozen=True)
class Budgets:
    """What a release may have at most, or must have at least (fixed values)."""

    most_parse_errors: float = 0.05  # share of source files with errors
    most_unlanguaged: float = 0.03  # share of files without a language
    most_silent: int = 0  # source files with content, no error and no symbol
    least_resolved: float = 0.5  # import edges for each import that was extracted
    unchecked_shapes: bool = False  # whether a release without any shape to conform to is fine


def ledger(files: DataFrame, imports: DataFrame) -> DataFrame:
    """One row of the four measures that have budgets; a measure without a denominator is null.

    files: (language, is_source, size, n_errors, n_symbols, n_imports), a null number counts 0; imports: a row for each edge.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    source = F.coalesce(F.col("is_source"), F.lit(False))
    silent = source & (n("size") > 0) & (n("n_errors") == 0) & (n("n_symbols") == 0)
    sums = files.agg(
        F.try_divide(F.count_if(source & (n("n_errors") > 0)), F.count_if(source)).alias("parse_errors"),
        F.try_divide(F.count_if(F.col("language").isNull()), F.count("*")).alias("unlanguaged"),
        F.count_if(silent).alias("silent"),
        F.sum(n("n_imports")).alias("extracted"),
    )
    edges = imports.agg(F.count("*").alias("edges"))  # one row each
    return sums.join(F.broadcast(edges), F.lit(True)).select(
        "parse_errors", "unlanguaged", F.col("silent").cast("double").alias("silent"), F.try_divide("edges", "extracted").alias("resolved")
    )


def _rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def _recounted(triples: DataFrame, counts: dict[str, int], classes: dict[str, str]) -> DataFrame:
    """The nodes of each class against the number that the manifest records; a class that it doesn't record isn't checked."""
    spark = triples.sparkSession
    asked = [(classes[c], c, float(n)) for c, n in sorted(counts.items()) if c in classes]
    wanted = spark.createDataFrame(asked, "o string, name string, bound double")
    nodes = triples.where((F.col("p") == ar.TYPE) & F.col("o").isin([o for o, _, _ in asked])).select("s", "o").distinct()
    met = F.broadcast(wanted).join(nodes.groupBy("o").agg(F.count("*").cast("double").alias("n")), "o", "left")
    found = F.coalesce(F.col("n"), F.lit(0.0))
    return met.select(F.lit("recount").alias("check"), "name", found.alias("found"), "bound", (found == F.col("bound")).alias("ok"))


def _within(measured: DataFrame, budgets: Budgets) -> DataFrame:
    limits = {"parse_errors": budgets.most_parse_errors, "unlanguaged": budgets.most_unlanguaged, "silent": budgets.most_silent, "resolved": budgets.least_resolved}
    each = [F.struct(F.lit("budget").alias("check"), F.lit(m).alias("name"), F.col(m).alias("found"), F.lit(float(v)).alias("bound"),
                     F.coalesce(F.col(m) >= v if m == "resolved" else F.col(m) <= v, F.lit(True)).alias("ok")) for m, v in limits.items()]
    return measured.select(F.inline(F.array(*each)))


def check(
    spark: SparkSession, place: str, classes: dict[str, str], budgets: Budgets = Budgets(), accepted: Collection[str] = (),
    shapes: Collection[cs.Shape] = (), digests: bool = True,
) -> DataFrame:
    """(check, name, found, bound, ok) of every check of a bundle.

    - manifest: it is there and can be read; without it there is no other row.
    - recount: nodes of each of `classes` (name to IRI) in the graph against `meta.counts`.
    - digest: each table is what the manifest says (found and bound are its rows, null for a table that is gone); not with `digests` false.
    - conforms: violations of `shapes` over the tables, at most 0, a row a shape. A shape on a table that is gone is not ok; without
      shapes one row says `skipped`, ok if the budgets allow it.
    - degradation: those that `meta.degradations` lists, component to reason, are ok if accepted. A manifest that lists none at
      all, not even an empty set, is not ok.
    - budget: the four measures of `ledger` against `budgets`; a measure without a denominator is ok, lost tables are not.
    """
    try:
        manifest = ar.read_manifest(spark, place)
    except (ValueError, AnalysisException):
        return _rows(spark, [("manifest", "manifest", None, None, False)])
    meta, tables = manifest["meta"], {}
    for name in manifest["tables"]:
        try:
            tables[name] = b.read_ntriples(spark, f"{place}/graph.nt") if name == "triples" else spark.read.parquet(f"{place}/{name}")
        except AnalysisException:  # its folder is gone, or holds no table
            pass
    rows: list[tuple] = [("manifest", "manifest", None, None, True)]
    if digests:
        for name, claim in sorted(manifest["tables"].items()):
            got = ar.fingerprint(tables[name]) if name in tables else None
            rows.append(("digest", name, got and float(got["rows"]), float(claim["rows"]), got == claim))
    known = meta.get("degradations")
    rows += [("degradation", "undisclosed", None, None, False)] if known is None else [("degradation", c, None, None, c in accepted) for c in sorted(known)]
    parts = []
    counts = {c: n for c, n in meta.get("counts", {}).items() if c in classes}
    if counts and "triples" in tables:
        parts.append(_recounted(tables["triples"], counts, classes))
    elif counts:
        rows += [("recount", c, None, float(n), False) for c, n in sorted(counts.items())]
    if not shapes:
        rows.append(("conforms", "skipped", None, None, budgets.unchecked_shapes))
    for s in shapes:
        try:
            bad = cs.validate(tables, [s]).agg(F.count("*").cast("double").alias("found"))
            parts.append(bad.select(F.lit("conforms"), F.lit(s.name), "found", F.lit(0.0), F.col("found") == 0))
        except KeyError:
            rows.append(("conforms", s.name, None, 0.0, False))
    if {"files", "imports"} <= tables.keys():
        parts.append(_within(ledger(tables["files"], tables["imports"]), budgets))
    else:
        rows.append(("budget", "tables", None, None, False))
    return reduce(DataFrame.unionAll, parts, _rows(spark, rows))


def orient(triples: DataFrame) -> DataFrame:
    """(class, predicate, subjects, values): for each class its predicates, with the subjects that have one and all its values.

    The row without a predicate counts the class's subjects. Subjects of several classes count in each, those of none under a null
    class. Repeated triples count once. Classes and predicates are the graph's own, so a hint is never about what isn't there.
    """
    each = triples.where("s IS NOT NULL AND p IS NOT NULL").groupBy("s", "p").agg(
        F.count_distinct("o", F.coalesce("datatype", F.lit("")), F.coalesce("lang", F.lit(""))).alias("n"),
        F.collect_set(F.when(F.col("p") == ar.TYPE, F.col("o"))).alias("classes"),  # empty but for the class's predicate
    )
    had = F.collect_list(F.when(F.col("p") != ar.TYPE, F.struct("p", "n")))
    subjects = each.groupBy("s").agg(F.flatten(F.collect_list("classes")).alias("classes"), had.alias("had"))
    none = F.array(F.lit(None).cast("string"))
    of = subjects.select(F.explode(F.when(F.size("classes") > 0, F.col("classes")).otherwise(none)).alias("class"), "had")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("p"), F.lit(1).cast("bigint").alias("n")))
    pairs = of.select("class", F.inline(F.concat(whole, F.col("had"))))
    return pairs.groupBy("class", F.col("p").alias("predicate")).agg(F.count("*").alias("subjects"), F.sum("n").alias("values"))
