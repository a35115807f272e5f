"""Quality rules as a ledger: every rule is evaluated once, policies are masks over the stored bits.

`ledger` keeps the measurements and one bit for each rule that a document fails. A policy is a named mask, so a
new version of it, or leaving a rule out, needs no second look at any text: `apply_policy` is a bitwise test, and
`ablation` counts the documents by their masked bits and derives what each rule does alone.

A null text is an empty one: it has no words and fails `few_words`. A long text is measured whole. Rows are returned
one for one, equal ones with equal bits, and an empty table gives an empty one. Other columns keep their values, but
none may have the name of one that is added.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches, new_columns
from graphloom.llm.textstats import measure

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower",
            "n_digits", "n_marks"]


def rules() -> list[tuple[str, Column]]:
    """Each rule's name and when a document fails it; its place in the list is its bit."""
    c = F.col
    return [
        ("few_words", c("n_words") < 10),
        ("repeated_words", 100 * c("n_repeat_words") > 20 * c("n_words")),
        ("symbols", 10 * c("n_symbols") > c("n_words")),
        ("repeated_lines", 10 * c("n_dup_lines") > 3 * c("n_lines")),
        ("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
        ("capitals", 2 * c("n_upper") > c("n_upper") + c("n_lower") + 10),
        ("digits", 2 * c("n_digits") > c("word_chars")),
        ("exclamations", 5 * c("n_marks") > c("n_words") + 20),
    ]


#: The rules' names in the order of rules(), for use without a Spark session.
NAMES = ["few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "capitals", "digits", "exclamations"]


def mask_of(*names: str) -> int:
    return sum(1 << NAMES.index(n) for n in names)


#: Policies by version; a version is never changed, only followed by another.
POLICIES = {
    "base-1": mask_of("few_words", "repeated_words"),
    "full-1": mask_of(*NAMES),
}


def ledger(documents: DataFrame, text: str = "text") -> DataFrame:
    """The key columns given besides `text`, with all measurements and failure_bits."""
    keys = [c for c in documents.columns if c != text]
    new_columns(keys, [*MEASURES, "failure_bits"])
    fields = [f.simpleString() for f in documents.select(*keys).schema.fields]
    schema = ", ".join([f"`{k}` {s.split(':', 1)[1]}" for k, s in zip(keys, fields)] + [f"{m} bigint" for m in MEASURES])

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [measure(t) for t in batch.column(text).to_pylist()]
            own = [batch.column(k) for k in keys]
            return pa.RecordBatch.from_arrays(
                own + [pa.array([x[m] for x in found], pa.int64()) for m in MEASURES], names=keys + MEASURES
            )

        return run

    bits = F.lit(0).cast("bigint")
    for at, (_, fails) in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << at)).otherwise(F.lit(0)).cast("bigint"))
    return map_batches(documents.select(*keys, text), make, schema).withColumn("failure_bits", bits)


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """The ledger with `policy`, and `kept`: whether none of the policy's rules failed."""
    mask = F.lit(POLICIES[version]).cast("bigint")
    new_columns(rows.columns, ["policy", "kept"])
    return rows.withColumn("policy", F.lit(version)).withColumn("kept", F.col("failure_bits").bitwiseAND(mask) == 0)


def ablation(rows: DataFrame, version: str) -> DataFrame:
    """What each rule of a policy does: (rule, n_failed, n_only, kept, kept_without).

    n_only documents fail no other rule of the policy; kept_without is what the policy without the rule keeps.
    """
    mask = POLICIES[version]
    by_bits = rows.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")).agg(
        F.count("*").alias("n")
    )
    named = F.array(
        *(
            F.struct(F.lit(n).alias("rule"), F.lit(1 << b).cast("bigint").alias("bit"))
            for b, n in enumerate(NAMES)
            if mask >> b & 1
        )
    )
    each = by_bits.select("bits", "n", F.explode(named).alias("r"))

    def total(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(0)).cast("bigint")

    return (
        each.groupBy(F.col("r.rule").alias("rule"))
        .agg(
            total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
            total(F.col("bits") == F.col("r.bit")).alias("n_only"),
            total(F.col("bits") == 0).alias("kept"),
        )
        .withColumn("kept_without", F.col("kept") + F.col("n_only"))
    )
