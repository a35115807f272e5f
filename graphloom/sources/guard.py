"""Read-only SQL over the engine's views, with a row cap and a time limit."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")

MOST_CHARS, MOST_ROWS, SECONDS = 10_000, 1_000, 10.0
CHANGES = re.compile(r"\b(insert|update|delete|merge|drop|create|alter|truncate|replace|set|reset|add|load|cache|uncache"
                     r"|refresh|grant|revoke|call|export|import|overwrite)\b", re.I)  # fmt: skip


class Refused(ValueError):
    """The statement isn't one that may be run."""


@dataclass
class Answer:
    columns: list[str]
    rows: list[tuple]
    truncated: bool


def check(sql: str) -> str:
    """The statement, if it is a single read of bounded length; texts in quotes aren't looked at."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    bare = bare.strip().rstrip(";").strip()
    if len(sql) > MOST_CHARS:
        raise Refused("too long")
    if not re.match(r"(?:select|with|values|from)\b", bare, re.I):
        raise Refused("only queries are run")
    if ";" in bare:
        raise Refused("one statement at a time")
    if word := CHANGES.search(bare):
        raise Refused(f"not allowed: {word[0].lower()}")
    return sql.strip().rstrip(";")


def bounded(spark: SparkSession, action: Callable[[], T], seconds: float) -> T:
    """What an action gives; its jobs are cancelled when the time is over."""
    group = f"guard-{threading.get_ident()}-{id(action)}"
    context = spark.sparkContext
    context.setJobGroup(group, "guarded query", interruptOnCancel=True)
    timer = threading.Timer(seconds, lambda: context.cancelJobGroup(group))
    timer.start()
    try:
        return action()
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def run(spark: SparkSession, sql: str, limit: int = MOST_ROWS, seconds: float = SECONDS) -> Answer:
    """Rows as texts, `limit` at most; one more is asked for to tell whether any were left out."""
    df = spark.sql(check(sql))
    rows = bounded(spark, lambda: df.limit(limit + 1).collect(), seconds)
    texts = [tuple(None if v is None else str(v) for v in r) for r in rows[:limit]]
    return Answer(df.columns, texts, len(rows) > limit)


def ask(spark: SparkSession, sql: str) -> bool:
    """Whether a query has a row."""
    return not spark.sql(check(sql)).isEmpty()
