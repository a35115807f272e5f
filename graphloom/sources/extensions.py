"""What users add to a bundle: columns of files, tables over all files, triples, shapes and tables beside the graph.

Extensions run in the order of their names, kind by kind, so a bundle doesn't depend on the order in which they were added.
All of them are expressions or functions from DataFrames to DataFrames; Spark plans what they give together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import constraints as cs
from graphloom.operators.scratch import materialize, release
from graphloom.sources import artifacts as ar

Tables = Mapping[str, DataFrame]
TRIPLE = "s string, p string, o string, o_kind string, datatype string, lang string"


@dataclass
class Extensions:
    """Named extensions of each kind; a name is taken once within its kind.

    - enrichers: columns by name, as expressions over a file's row, so rows are neither lost nor repeated; a later one sees the
      columns of those before it, and none may take the name of a column that is there.
    - aggregators: from all files and what aggregators before gave, to a table. An optional one that fails leaves a degradation.
    - contributors: from the files and the aggregators' tables to triples.
    - shapes: what the bundle's tables must conform to.
    - emitters: from the files and the aggregators' tables to tables of the bundle; none may give a table that is there.
    """

    enrichers: dict[str, Mapping[str, Column]] = field(default_factory=dict)
    aggregators: dict[str, tuple[Callable[[DataFrame, Tables], DataFrame], bool]] = field(default_factory=dict)
    contributors: dict[str, Callable[[DataFrame, Tables], DataFrame]] = field(default_factory=dict)
    shapes: dict[str, list[cs.Shape]] = field(default_factory=dict)
    emitters: dict[str, Callable[[DataFrame, Tables], Tables]] = field(default_factory=dict)

    def _add(self, kind: str, name: str, what: object) -> Extensions:
        known = getattr(self, kind)
        if name in known:
            raise ValueError(f"{kind}: {name} is there already")
        known[name] = what
        return self

    def enricher(self, name: str, **columns: Column) -> Extensions:
        return self._add("enrichers", name, columns)

    def aggregator(self, name: str, f: Callable[[DataFrame, Tables], DataFrame], optional: bool = False) -> Extensions:
        return self._add("aggregators", name, (f, optional))

    def contributor(self, name: str, f: Callable[[DataFrame, Tables], DataFrame]) -> Extensions:
        return self._add("contributors", name, f)

    def shape(self, name: str, shapes: list[cs.Shape]) -> Extensions:
        return self._add("shapes", name, shapes)

    def emitter(self, name: str, f: Callable[[DataFrame, Tables], Tables]) -> Extensions:
        return self._add("emitters", name, f)

    def enriched(self, files: DataFrame) -> DataFrame:
        for name, columns in sorted(self.enrichers.items()):
            if taken := sorted(set(columns) & set(files.columns)):
                raise ValueError(f"{name}: {', '.join(taken)} are columns already")
            files = files.withColumns(dict(columns))
        return files

    def all_shapes(self) -> list[cs.Shape]:
        return [s for _, shapes in sorted(self.shapes.items()) for s in shapes]

    def emit(self, files: DataFrame, triples: DataFrame, place: str, meta: dict[str, object] | None = None) -> dict:
        """Write the bundle of the files and all that the extensions give, and return its manifest.

        The files are a table of it. Aggregators' tables are written to shared scratch space first, so that one that fails does so
        before the bundle is begun, and are in the bundle only if an emitter puts them there. `degradations` name those that failed.
        """
        rows = self.enriched(files)
        made: dict[str, DataFrame] = {}
        failed = dict((meta or {}).get("degradations", {}))
        try:
            for name, (f, optional) in sorted(self.aggregators.items()):
                try:
                    made[name] = materialize(f(rows, dict(made)))
                except Exception as e:  # whatever an optional extension raises is disclosed, and the bundle goes on without it
                    if not optional:
                        raise
                    failed[name] = f"{type(e).__name__}: {e}".splitlines()[0][:200]
            columns = [c.split()[0] for c in TRIPLE.split(", ")]
            more = [f(rows, made).select(columns) for _, f in sorted(self.contributors.items())]
            tables = {"files": rows}
            for name, f in sorted(self.emitters.items()):
                given = f(rows, made)
                if taken := sorted(set(given) & {*tables, "triples", ar.MANIFEST}):
                    raise ValueError(f"{name}: {', '.join(taken)} are tables already")
                tables |= given
            whole = reduce(DataFrame.unionAll, more, triples.select(columns))
            return ar.emit(tables, whole, place, {**(meta or {}), "degradations": failed})
        finally:
            for df in made.values():
                release(df)


def literals(rows: DataFrame, subject: Column, predicate: str, value: Column) -> DataFrame:
    """Triples with a plain literal for each row; rows with a null subject or value give none."""
    none = F.lit(None).cast("string")
    out = rows.select(subject.alias("s"), F.lit(predicate).alias("p"), value.cast("string").alias("o"), F.lit("literal").alias("o_kind"), none.alias("datatype"), none.alias("lang"))
    return out.where("s IS NOT NULL AND o IS NOT NULL")
