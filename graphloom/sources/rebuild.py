"""Tables rebuilt from a graph, and markers found in the contents of files.

`pivot` turns triples into the tables that a schema names in one pass: each subject's triples meet once, whatever number of
tables and predicates there is. `rebuild` does so for the graph of a bundle whose tables are lost, and says which of them are what the manifest says.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.scratch import materialize
from graphloom.sources import artifacts as ar
from graphloom.sources import bundle as b


@dataclass(frozen=True)
class Shape:
    """A table of the subjects of a class: `key` is the subject without `base`, columns are (name, predicate, type).

    A type of array<...> takes all objects, sorted; any other one the least, null where there is none.
    """

    cls: str
    key: str
    key_type: str
    base: str
    columns: tuple[tuple[str, str, str], ...]


def pivot(triples: DataFrame, shapes: dict[str, Shape]) -> dict[str, DataFrame]:
    """The tables of all shapes. Subjects of several classes are in several tables; repeated triples count once."""
    wanted = sorted({p for s in shapes.values() for _, p, _ in s.columns})
    several = {p for s in shapes.values() for _, p, kind in s.columns if kind.startswith("array")}
    classes = F.collect_set(F.when(F.col("p") == ar.TYPE, F.col("o"))).alias("classes")
    values = [(F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o")))) if p in several else F.min(F.when(F.col("p") == p, F.col("o")))).alias(f"v{i}") for i, p in enumerate(wanted)]
    used = triples.where(F.col("p").isin(ar.TYPE, *wanted))
    rows = materialize(used.groupBy("s").agg(classes, *values))
    out = {}
    for name, s in shapes.items():
        key = F.substring(F.col("s"), len(s.base) + 1, 1 << 30).cast(s.key_type).alias(s.key)
        held = rows.where(F.array_contains("classes", s.cls) & F.startswith("s", F.lit(s.base)))

        def column(p: str, kind: str):
            v = F.col(f"v{wanted.index(p)}")
            one = F.get(v, 0) if p in several and not kind.startswith("array") else v
            return one.cast(kind)

        out[name] = held.select(key, *[column(p, kind).alias(c) for c, p, kind in s.columns])
    return out


def rebuild(spark: SparkSession, place: str, shapes: dict[str, Shape]) -> tuple[dict[str, DataFrame], dict[str, bool]]:
    """The tables of a bundle from its N-Triples alone, and for each whether it is the one that the manifest names."""
    manifest = ar.read_manifest(spark, place)["tables"]
    tables = pivot(b.read_ntriples(spark, f"{place}/graph.nt"), shapes)
    return tables, {n: ar.fingerprint(df) == manifest.get(n) for n, df in tables.items()}


def find_markers(files: DataFrame, blobs: DataFrame, markers: list[str]) -> DataFrame:
    """(path, marker) of the markers in each file's contents. files: (path, digest); blobs: (digest, text).

    A content is searched once, for all markers at once, however many files have it. A marker inside of another one or overlapping it is found too.
    """
    known = sorted(set(markers), key=lambda m: (-len(m), m))
    if not known or "" in known:
        raise ValueError("markers must be given and not be empty")
    inside = {m: [x for x in known if x in m] for m in known}
    looked = "(?=(" + "|".join(re.escape(m).replace("'", r"\x27") for m in known) + "))"  # at each place the longest one
    each = blobs.join(files.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    hits = each.select("digest", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(looked), F.lit(1)))).alias("hit"))
    implied = F.create_map(*[x for m, v in inside.items() for x in (F.lit(m), F.array(*map(F.lit, v)))])
    found = hits.select("digest", F.explode(implied[F.col("hit")]).alias("marker")).distinct()
    return files.select("path", "digest").join(found, "digest").select("path", "marker")
