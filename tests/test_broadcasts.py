"""Joins of two tables that both grow with the input: neither side goes through the driver by Spark's own guess of its size."""

import pytest

from graphloom.llm import jaccard
from graphloom.operators import components
from graphloom.plans import catalog

D = "/root/testdata/sf0.001"


def joins(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [x for x in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "SortMergeJoin") if x in plan]


@pytest.mark.parametrize(
    "name",
    [
        "imports_typescript",
        "imports_c",
        "imports_cfml",
        "imports_clojure",
        "imports_c_several",
        "imports_java",
        "imports_php",
        "imports_objective_c",
        "imports_python",
        "imports_rust",
        "imports_ruby",
        "imports_swift",
        "imports_css",
    ],
)
def test_imports_meet_paths_in_shuffles(spark, name):
    assert joins(catalog.QUERIES[name](spark, D)) == ["SortMergeJoin"]


def test_jaccard_broadcasts_its_bitmap_alone(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return kept(df)

    kept = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", seen)
    monkeypatch.setattr(components, "materialize", seen)
    found = jaccard.near_duplicates(spark.read.parquet(f"{D}/documents.parquet"))
    plans.append(found._jdf.queryExecution().sparkPlan().toString())
    sent = [line for plan in plans for line in plan.split("\n") if "BroadcastHashJoin" in line]
    assert len(plans) > 5 and len(sent) == 1 and "BroadcastHashJoin [word" in sent[0]
