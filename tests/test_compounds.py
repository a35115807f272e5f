"""Compounds cut into their parts, against all cuts of short names."""

import random

import pytest

from graphloom.operators import services as sv
from graphloom.operators.components import connected_components


def cuts(words, parts):
    if not words:
        yield []
    for k in range(len(words), 0, -1):
        if "_".join(words[:k]) in parts:
            for rest in cuts(words[k:], parts):
                yield ["_".join(words[:k]), *rest]


def test_parts(spark):
    r = random.Random(9)
    rows = [("a_b_a", ["a", "b"]), ("a_b_compound", ["a", "b"]), ("compound", ["compound"]), ("x", ["y", "a"]), ("", [""]), (None, ["b", "a"]), ("a", None)]
    rows += [("a__b", ["a", "", "b"]), ("_".join(["ab", "c"] * 40), ["ab", "c"]), ("_".join("ab" * 30), ["a", "b", "a_b"])]
    for _ in range(60):
        words = [r.choice("ab") for _ in range(r.randint(1, 7))]
        parts = {"_".join(words[i : i + r.randint(1, 3)]) for i in [r.randrange(len(words)) for _ in range(r.randint(1, 4))]}
        rows.append(("_".join(words) + r.choice(["", "_compound"]), sorted(parts)))
    want = []
    for name, parts in rows:
        held = set(parts or [])
        best = None
        if name is not None and held and len(name) < 30:
            for base in (name, name.removesuffix("_compound")):
                best = best or next((c for c in cuts(base.split("_"), held) if set(c) == held), None)
        elif name == rows[8][0]:
            best = ["ab", "c"] * 40
        elif name == rows[9][0]:
            best = ["a_b"] * 28 + ["a_b", "a", "b"]
        want.append((name, best or sorted(held)))
    got = sv.compound_parts(spark.createDataFrame(rows, "id string, parts array<string>")).collect()
    assert [(x.id, list(x.parts)) for x in got] == want


def test_components_raise_when_rounds_are_too_few(spark):
    chain = spark.range(200).selectExpr("id AS src", "id + 1 AS dst")
    with pytest.raises(RuntimeError, match="not final"):
        connected_components(chain, rounds=1)
