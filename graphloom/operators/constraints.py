"""Declared constraints compiled to queries that return their violations.

A shape names a table and its key; each of its properties gives one violation query, and the union of them is the
report (shape, path, constraint, focus, value). Data conform if it is empty. An unknown constraint is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN = {"min_count", "max_count", "datatype", "one_of", "has_value", "references", "pattern", "min_inclusive", "min_length", "unique"}


@dataclass
class Property:
    path: str
    rules: dict[str, Any]


@dataclass
class Shape:
    name: str
    table: str
    key: str
    properties: list[Property] = field(default_factory=list)


def _row(df: DataFrame, shape: Shape, p: Property, rule: str, bad: Column) -> DataFrame:
    return df.where(bad).select(
        F.lit(shape.name).alias("shape"),
        F.lit(p.path).alias("path"),
        F.lit(rule).alias("constraint"),
        F.col(shape.key).cast("string").alias("focus"),
        F.col(p.path).cast("string").alias("value"),
    )


def _violations(tables: dict[str, DataFrame], shape: Shape, p: Property, rule: str, arg: Any) -> DataFrame:
    df, c = tables[shape.table], F.col(p.path)
    if rule not in KNOWN:
        raise ValueError(f"unknown constraint: {rule}")
    if rule == "min_count":  # a single-valued column counts one where it isn't null
        return _row(df, shape, p, rule, F.lit(arg > 0) & c.isNull())
    if rule == "max_count":
        n = df.where(c.isNotNull()).groupBy(shape.key).agg(F.count("*").alias("_n"), F.min(p.path).alias(p.path))
        return _row(n, shape, p, rule, F.col("_n") > arg)
    if rule == "unique":
        n = df.groupBy(p.path).agg(F.count("*").alias("_n"), F.min(shape.key).alias(shape.key))
        return _row(n, shape, p, rule, F.col("_n") > 1)
    if rule == "references":
        other, column = arg
        keys = tables[other].select(F.col(column).alias("_k")).distinct()
        return _row(df.where(c.isNotNull()).join(keys, c == F.col("_k"), "left_anti"), shape, p, rule, F.lit(True))
    bad = {
        "datatype": lambda: c.cast("string").try_cast(arg).isNull(),
        "one_of": lambda: ~c.isin(arg),
        "has_value": lambda: c != arg,
        "pattern": lambda: ~c.cast("string").rlike(arg),
        "min_inclusive": lambda: c < arg,
        "min_length": lambda: F.length(c.cast("string")) < arg,
    }[rule]()
    return _row(df, shape, p, rule, c.isNotNull() & bad)


def validate(tables: dict[str, DataFrame], shapes: list[Shape]) -> DataFrame:
    found = [
        _violations(tables, s, p, rule, arg) for s in shapes for p in s.properties for rule, arg in p.rules.items()
    ]
    return reduce(DataFrame.unionAll, found)


def budgets(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(metric, value, budget, ok) of a one-row frame of metrics; a null metric fails."""
    each = F.array(
        *(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(b)).alias("budget"))
          for m, b in limits.items())
    )
    rows = metrics.select(F.inline(each))
    return rows.withColumn("ok", F.coalesce(F.col("value") <= F.col("budget"), F.lit(False)))
