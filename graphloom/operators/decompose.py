"""Decomposition of a file graph into modules with findings, and the order in which they can be built.

Inputs: files (path, type, language), edges (src, dst) between paths. A module is a file's directory; the root is ".".
Findings share one schema: (gate, severity, subject, confidence, evidence).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import classify as cl
from graphloom.functions.text import basename, dirname
from graphloom.operators import relational as op
from graphloom.operators.condense import dependencies, least_above
from graphloom.operators.pieces import cycles, scc_layers
from graphloom.operators.scratch import materialize
from graphloom.operators.setjoin import jaccard_pairs

ROOT = "."
#: Coupling from which a module is a hub, the alikeness of duplicated ones, and the concepts they need.
HUB, ALIKE, LEAST_CONCEPTS = 6, 0.6, 5
KERNEL = ["shared_kernel", "kernel"]
SHARED = [*KERNEL, "common", "shared"]
#: Confidence from the weakest to the surest.
CONFIDENCE = ["unknown", "weak", "probable", "strong", "certain"]


def module_of(path: Column) -> Column:
    d = dirname(path)
    return F.when(d == "", ROOT).otherwise(d)


def weakest(*confidence: Column) -> Column:
    """The least sure of several confidences."""
    order = F.array(*map(F.lit, CONFIDENCE))
    return F.element_at(order, F.least(*(F.array_position(order, c) for c in confidence)).cast("int"))


def modules(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("node"), module_of(F.col("path")).alias("module"))


def _finding(df: DataFrame, gate: str, severity: str, subject: Column, confidence: str | Column, evidence: Column) -> DataFrame:
    sure = F.lit(confidence) if isinstance(confidence, str) else confidence
    return df.select(
        F.lit(gate).alias("gate"),
        F.lit(severity).alias("severity"),
        subject.alias("subject"),
        sure.alias("confidence"),
        evidence.cast("string").alias("evidence"),
    )


def _name(c: str) -> Column:
    return F.concat(F.lit("module:"), F.col(c))


def gates(files: DataFrame, edges: DataFrame, concepts: DataFrame, xref_targets: DataFrame, tested: DataFrame) -> DataFrame:
    """All findings. concepts: (path, concept); xref_targets and tested: (path)."""
    m = modules(files)
    rolled = op.module_edges(edges, m)
    coupled = op.coupling(rolled)
    into = edges.select(F.col("dst").alias("path")).distinct()
    out = edges.select(F.col("src").alias("path")).distinct()
    code = files.where("type = 'source_code'")
    entry = cl.entry_point(F.col("path"), F.col("type"))
    loose = code.where(entry.isNull()).join(into, "path", "left_anti")

    hubs = coupled.where((F.col("ca") >= HUB) & (F.col("ce") >= HUB))
    found = [_finding(hubs, "god_module", "warning", _name("module"), "strong", F.format_string("Ca=%d Ce=%d", "ca", "ce"))]

    special = basename(F.col("path")).isin("__init__.py", "__main__.py", "conftest.py")
    aimed = xref_targets.select("path").distinct().withColumn("aimed", F.lit(True))
    dead = loose.where(~special).join(aimed, "path", "left").withColumn("aimed", F.coalesce("aimed", F.lit(False)))
    sure = F.when(F.col("aimed"), "weak").otherwise("probable")
    found.append(_finding(dead, "dead_code_candidate", "info", F.col("path"), sure, F.concat(F.lit("xref_targeted="), "aimed")))

    phases = cl.phases(F.col("path"), F.col("type"))
    hidden = loose.where(F.array_contains(phases, "runtime")).join(out, "path", "left_semi")
    found.append(_finding(hidden, "hidden_entrypoint", "info", F.col("path"), "weak", F.lit("imports_in=0 imports_out>0")))

    owned = concepts.join(m.withColumnRenamed("node", "path"), "path").select("module", "concept")
    alike = jaccard_pairs(owned, "module", "concept", ALIKE, LEAST_CONCEPTS)
    both = F.concat(_name("a"), F.lit(", "), _name("b"))
    found.append(_finding(alike, "duplicated_responsibility", "info", both, "weak", F.format_string("jaccard=%.2f", "jaccard")))

    made = files.where("type = 'generated'").join(edges, F.col("path") == F.col("dst")).groupBy("path").agg(F.count("*").alias("n"))
    found.append(_finding(made, "generated_drives_architecture", "warning", F.col("path"), "strong", F.format_string("imports_in=%d", "n")))

    tests = files.where("type = 'test_code'").select(F.col("path").alias("src"))
    reached = edges.join(tests, "src", "left_semi").select(F.col("dst").alias("node")).unionAll(tested.select(F.col("path").alias("node")))
    covered = m.join(reached, "node", "left_semi").select("module").distinct()
    sources = code.join(m.withColumnRenamed("node", "path"), "path").where(F.col("module") != ROOT)
    gaps = sources.groupBy("module").agg(F.count("*").alias("n")).join(covered, "module", "left_anti")
    found.append(_finding(gaps, "test_gap", "warning", _name("module"), "probable", F.format_string("code_files=%d", "n")))

    unknown = files.where("type = 'unknown'").agg(F.count("*").alias("n")).where("n > 0")
    found.append(_finding(unknown, "missing_evidence", "info", F.lit("file-type=unknown"), "certain", F.col("n")))

    top = lambda c: F.substring_index(c, "/", 1)
    outside = rolled.where((F.col("sm") != ROOT) & (top("sm") != top("dm")))
    owners = outside.groupBy("dm").agg(F.array_sort(F.collect_set(top("sm"))).alias("tops")).where(F.size("tops") >= 2)
    owners = owners.where(~F.arrays_overlap(F.split("dm", "/"), F.array(*map(F.lit, SHARED))))
    found.append(_finding(owners, "ambiguous_ownership", "info", _name("dm"), "probable", F.array_join("tops", ",")))

    ring = cycles(edges)
    found.append(_finding(ring, "circular_dependency", "warning", F.col("component"), "certain", F.format_string("files=%d", "size")))
    around = cycles(rolled.select(F.col("sm").alias("src"), F.col("dm").alias("dst")))
    found.append(_finding(around, "directory_cycle", "info", _name("component"), "probable", F.format_string("directories=%d", "size")))
    return reduce(DataFrame.unionAll, found)


def architecture_violations(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, a, b): kernels that import outward, and directories that import each other."""
    rolled = op.module_edges(edges, modules(files))
    kernel = rolled.where(F.arrays_overlap(F.split("sm", "/"), F.array(*map(F.lit, KERNEL))))
    outward = kernel.where(~F.startswith("dm", F.concat("sm", F.lit("/"))))
    both = op.mutual(rolled.select(F.col("sm").alias("src"), F.col("dm").alias("dst")))
    return outward.select(F.lit("shared_kernel_not_independent").alias("kind"), F.col("sm").alias("a"), F.col("dm").alias("b")).unionAll(
        both.select(F.lit("bidirectional_coupling").alias("kind"), "a", "b")
    )


def part_kinds(files: DataFrame) -> DataFrame:
    """(kind, part, n_files): every file belongs to one part, by its type and directory."""
    t = F.col("type")
    kind = (
        F.when(t.isin("source_code", "test_code"), "module")
        .when(t.isin("build_script", "ci_cd", "container", "environment", "dependency_manifest", "lockfile"), "operational")
        .when(t.isin("documentation", "license"), "documentation")
        .when(t == "generated", "generated_artifact")
        .when(t == "configuration", "configuration")
        .when(t.isin("data", "asset", "binary"), "data")
        .otherwise("unclassified")
    )
    part = F.when(kind == "module", module_of(F.col("path"))).otherwise(t)
    return files.groupBy(kind.alias("kind"), part.alias("part")).agg(F.count("*").alias("n_files"))


def build_plan(files: DataFrame, edges: DataFrame, phase_of: DataFrame, relax: bool = True) -> DataFrame:
    """(step, unit, module, phase, layer): modules in an order in which no step needs a later one.

    phase_of: (module, phase). Modules of one cycle are one unit, at its earliest member's phase. A dependency's phase is
    pulled down to the earliest of those that depend on it, directly or not; without `relax` it stays, and steps may need later
    ones. Steps are numbered by phase, layer and name.
    """
    m = modules(files)
    rolled = materialize(op.module_edges(edges, m).select(F.col("sm").alias("src"), F.col("dm").alias("dst")))
    layered = scc_layers(rolled).select(F.col("node").alias("module"), F.col("component").alias("unit"), "layer")
    every = m.select("module").distinct().join(layered, "module", "left")
    units = materialize(every.withColumn("unit", F.coalesce("unit", "module")).withColumn("layer", F.coalesce("layer", F.lit(0))))
    own = units.join(phase_of, "module", "left").groupBy(F.col("unit").alias("node")).agg(F.min(F.coalesce("phase", F.lit(0))).alias("value"))
    if relax:
        found = units.select(F.col("module").alias("node"), F.col("unit").alias("component"))
        own = least_above(materialize(dependencies(rolled, found)), own)
    placed = units.join(own.select(F.col("node").alias("unit"), F.col("value").alias("phase")), "unit")
    by_unit = placed.groupBy("unit").agg(F.min("phase").alias("phase"), F.min("layer").alias("layer"))
    numbered = op.dense_ids(by_unit, ["phase", "layer", "unit"]).withColumn("step", (F.col("row") + 1).cast("int")).drop("row")
    return placed.select("unit", "module").join(numbered, "unit").select("step", "unit", "module", "phase", "layer")


def unit_steps(files: DataFrame, edges: DataFrame, plan: DataFrame) -> DataFrame:
    """(step, creates, tests, requires) of a plan's units: its files, those of them that are tests, and the steps that it needs."""
    at = modules(files).withColumnRenamed("node", "path").join(plan.select("module", "step"), "module")
    made = files.join(at.select("path", "step"), "path").groupBy("step").agg(
        F.array_sort(F.collect_set("path")).alias("creates"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "test_code", F.col("path")))).alias("tests"),
    )
    s = at.select(F.col("path").alias("src"), "step")
    d = at.select(F.col("path").alias("dst"), F.col("step").alias("needs"))
    needs = edges.join(s, "src").join(d, "dst").where("step <> needs").groupBy("step").agg(F.array_sort(F.collect_set("needs")).alias("requires"))
    return made.join(needs, "step", "left").select("step", "creates", "tests", F.coalesce("requires", F.array().cast("array<int>")).alias("requires"))


def cycle_resolutions(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(unit, path, layer, resolvable) of the files of modules that import each other in a ring, a unit for each ring.

    If the files of a unit have no ring of their own among them, they can be ordered by layer; else the layers are null.
    """
    m = modules(files)
    rolled = op.module_edges(edges, m).select(F.col("sm").alias("src"), F.col("dm").alias("dst"))
    rings = scc_layers(rolled).where("size > 1").select(F.col("node").alias("module"), F.col("component").alias("unit"))
    inside = m.join(op.shuffled(rings), "module").select("node", "unit")
    s = inside.select(F.col("node").alias("src"), "unit")
    d = inside.select(F.col("node").alias("dst"), F.col("unit").alias("other"))
    own = edges.join(op.shuffled(s), "src").join(op.shuffled(d), "dst").where("unit = other").select("src", "dst")
    layered = scc_layers(own).select("node", F.col("size").alias("ring"), F.col("layer").alias("at"))
    placed = inside.join(op.shuffled(layered), "node", "left").withColumn("ring", F.coalesce("ring", F.lit(1)))
    able = placed.groupBy("unit").agg((F.max("ring") == 1).alias("resolvable"))
    order = F.when(F.col("resolvable"), F.coalesce("at", F.lit(0)))
    return placed.join(op.shuffled(able), "unit").select("unit", F.col("node").alias("path"), order.alias("layer"), "resolvable")


def forward_dependencies(plan: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps of a plan that need a later one; there must be none."""
    rolled = op.module_edges(edges, modules(files))
    s = plan.select(F.col("module").alias("sm"), F.col("step").alias("at"))
    d = plan.select(F.col("module").alias("dm"), F.col("step").alias("needs"))
    return rolled.join(s, "sm").join(d, "dm").where("needs > at").select("sm", "dm", "at", "needs")


def creates_and_modifies(claims: DataFrame) -> DataFrame:
    """(path, step, action) of claims (path, step): the first step creates a file, later ones modify it."""
    first = claims.groupBy("path").agg(F.min("step").alias("_first"))
    action = F.when(F.col("step") == F.col("_first"), "creates").otherwise("modifies")
    return claims.distinct().join(first, "path").select("path", "step", action.alias("action"))


def unassigned(files: DataFrame, claims: DataFrame) -> DataFrame:
    """Files that no step creates."""
    return files.select("path").join(claims.select("path"), "path", "left_anti")
