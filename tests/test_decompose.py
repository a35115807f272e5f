from pyspark.sql import functions as F

from graphloom.operators import decompose as dc

FILES = [
    ("main.py", "source_code"), ("app/a.py", "source_code"), ("app/b.py", "source_code"), ("lib/c.py", "source_code"),
    ("lib/__init__.py", "source_code"), ("lib/d.py", "source_code"), ("gen/g.py", "generated"), ("tests/test_a.py", "test_code"),
    ("kernel/k.py", "source_code"), ("x.bin", "unknown"), ("README.md", "documentation"), ("other/o.py", "source_code"),
]
EDGES = [("main.py", "app/a.py"), ("app/a.py", "lib/c.py"), ("lib/c.py", "kernel/k.py"), ("kernel/k.py", "app/b.py"),
         ("app/b.py", "gen/g.py"), ("tests/test_a.py", "app/a.py"), ("other/o.py", "lib/c.py"), ("lib/c.py", "lib/d.py"),
         ("lib/d.py", "lib/c.py")]


def frames(spark):
    files = spark.createDataFrame([(p, t, "python") for p, t in FILES], "path string, type string, language string")
    return files, spark.createDataFrame(EDGES, "src string, dst string")


def test_gates(spark):
    files, edges = frames(spark)
    concepts = spark.createDataFrame([(p, c) for p in ("app/a.py", "other/o.py") for c in "abcde"], "path string, concept string")
    empty = files.limit(0).select("path")
    found = {(r.gate, r.subject, r.confidence) for r in dc.gates(files, edges, concepts, empty, empty).collect()}
    assert {x for x in found if x[0] in ("dead_code_candidate", "hidden_entrypoint")} == {
        ("dead_code_candidate", "other/o.py", "probable"), ("hidden_entrypoint", "other/o.py", "weak"),
    }
    assert ("duplicated_responsibility", "module:app, module:other", "weak") in found
    assert ("generated_drives_architecture", "gen/g.py", "strong") in found
    assert {x[1] for x in found if x[0] == "test_gap"} == {"module:lib", "module:kernel", "module:other"}
    assert {x[1] for x in found if x[0] == "ambiguous_ownership"} == {"module:lib", "module:app"}
    assert ("circular_dependency", "lib/c.py", "certain") in found
    assert ("directory_cycle", "module:app", "probable") in found
    assert ("missing_evidence", "file-type=unknown", "certain") in found
    bad = {tuple(r) for r in dc.architecture_violations(files, edges).collect()}
    assert bad == {("shared_kernel_not_independent", "kernel", "app")}


def test_plan(spark):
    files, edges = frames(spark)
    phase = spark.createDataFrame([("app", 4), ("lib", 2), ("gen", 9), ("other", 1)], "module string, phase int")
    plan = dc.build_plan(files, edges, phase)
    at = {r.module: (r.unit, r.phase) for r in plan.collect()}
    assert at["app"][0] == at["lib"][0] == at["kernel"][0] == "app"
    assert at["gen"][1] == 0  # pulled down: the root needs it, through app
    assert dc.forward_dependencies(plan, files, edges).count() == 0
    stated = dc.build_plan(files, edges, phase, relax=False)
    assert {r.dm for r in dc.forward_dependencies(stated, files, edges).collect()} == {"gen"}
    steps = {r.step: r for r in dc.unit_steps(files, edges, plan).collect()}
    ring = next(s for s in steps.values() if "app/a.py" in s.creates)
    assert ring.creates == sorted(p for p, _ in FILES if p.split("/")[0] in ("app", "lib", "kernel"))
    assert [steps[x].creates for x in ring.requires] == [["gen/g.py"]] and all(x < s.step for s in steps.values() for x in s.requires)
    assert next(s for s in steps.values() if s.tests).tests == ["tests/test_a.py"]
    assert {r.module for r in plan.collect()} == {"app", "lib", "gen", "kernel", "other", "tests", "."}
    claims = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "path string, step int")
    assert {tuple(r) for r in dc.creates_and_modifies(claims).collect()} == {("a", 1, "creates"), ("a", 2, "modifies"), ("b", 3, "creates")}
    assert dc.unassigned(spark.createDataFrame([("a",), ("z",)], "path string"), claims).collect()[0].path == "z"
    parts = dc.part_kinds(files)
    assert parts.agg(F.sum("n_files")).first()[0] == len(FILES)


def test_weakest(spark):
    df = spark.createDataFrame([("certain", "weak"), ("strong", "probable")], "a string, b string")
    assert [r.c for r in df.select(dc.weakest(F.col("a"), F.col("b")).alias("c")).collect()] == ["weak", "probable"]
