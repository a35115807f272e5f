"""Configs that extend others: order, overrides, several parents, rings, missing ones, and many repositories at once."""

import json

from graphloom.sources.resolve import tsconfigs


def conf(extends=None, base=None, paths=None):
    options = {k: v for k, v in (("baseUrl", base), ("paths", paths)) if v is not None}
    return json.dumps({k: v for k, v in (("extends", extends), ("compilerOptions", options)) if v})


FILES = {
    "tsconfig.base.json": conf(None, "src", {"@a/*": ["a/*"], "@b": ["b"]}),
    "tsconfig.json": '{ // own\n "extends": "./tsconfig.base", "compilerOptions": {"paths": {"@b": ["mine"], "@c": ["c"],},} }',
    "pkg/tsconfig.json": conf(["../tsconfig.json", "./tsconfig.extra.json", "./missing"], None, {"@d": ["d"]}),
    "pkg/tsconfig.extra.json": conf(None, "extra", {"@a/*": ["x/*"], "@e": ["e"]}),
    "ring/tsconfig.json": conf("./tsconfig.other.json", None, {"@r": ["1"]}),
    "ring/tsconfig.other.json": conf("./tsconfig.json", "there", {"@r": ["2"], "@s": ["3"]}),
    "up/jsconfig.json": conf("../pkg"),
    "named/tsconfig.json": conf("some-package/tsconfig.json", "n"),
}
WANT = {
    "tsconfig.base.json": ("src", [("@a/*", ["a/*"]), ("@b", ["b"])]),
    "tsconfig.json": ("src", [("@a/*", ["a/*"]), ("@b", ["mine"]), ("@c", ["c"])]),
    "pkg/tsconfig.extra.json": ("extra", [("@a/*", ["x/*"]), ("@e", ["e"])]),
    "pkg/tsconfig.json": ("extra", [("@a/*", ["x/*"]), ("@b", ["mine"]), ("@c", ["c"]), ("@e", ["e"]), ("@d", ["d"])]),
    "ring/tsconfig.json": ("there", [("@r", ["1"]), ("@s", ["3"])]),
    "ring/tsconfig.other.json": ("there", [("@r", ["2"]), ("@s", ["3"])]),
    "up/jsconfig.json": ("extra", [("@a/*", ["x/*"]), ("@b", ["mine"]), ("@c", ["c"]), ("@e", ["e"]), ("@d", ["d"])]),
    "named/tsconfig.json": ("n", []),
}


def test_configs(spark):
    rows = [(k, p, t) for k in ("one", "two") for p, t in FILES.items()] + [("three", "tsconfig.json", conf("./tsconfig.base"))]
    got = tsconfigs(spark.createDataFrame(rows, "repo string, path string, text string")).collect()
    found = {(r.repo, r.path): (r.base, [(e["key"], e["value"]) for e in r.paths]) for r in got}
    assert found == {(k, p): w for k in ("one", "two") for p, w in WANT.items()} | {("three", "tsconfig.json"): (".", [])}
