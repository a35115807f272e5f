"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations alone.

A benchmark item is cut into windows of `window` consecutive words. The tokens of every window are ordered by
how rare they are in the documents. All of a window's tokens must occur for it to be contained, so its
necessary prefix is one token: the rarest. Documents meet windows on that token only; the token's position
gives where the window would have to start, the document's length and that position bound it, and the
words of that item-sized window are then compared one by one.

Null or wordless texts have no words and no hits, long ones are searched whole. Items with a null id or without words
are left out, and items that share a window each have it. A document row that occurs n times is returned n times, an
empty table of either kind gives no hits. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, words

#: Windows sent to executors at once. A window is `window` words, so this bounds a broadcast.
BLOCK_WINDOWS = 100_000
#: Benchmark words held in a broadcast while the documents' words are counted; above it, they are joined.
BROADCAST_WORDS = 500_000


def item_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Distinct windows (win array<string>, n int, items array<bigint>); a shorter item is one window."""
    items = benchmark.select(F.col("item_id").alias("item"), words(F.col("text")).alias("w")).where(
        "item IS NOT NULL AND size(w) > 0"
    )
    each = items.select(
        "item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))).alias("at")
    )
    return (
        each.select("item", F.slice("w", F.col("at"), F.lit(window)).alias("win"))
        .groupBy("win")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("n", F.size("win"))
    )


def word_counts(documents: DataFrame, vocabulary: DataFrame, few: bool) -> DataFrame:
    """How often each word of `vocabulary` occurs in all the documents: (word, df)."""
    said = documents.select(F.explode(words(F.col("text"))).alias("word"))
    if few:
        return said.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("df"))
    return said.groupBy("word").agg(F.count("*").alias("df")).join(vocabulary, "word")


def anchors(windows: DataFrame, counts: DataFrame, few: bool = False) -> DataFrame:
    """Each window with its rarest token and that token's place; windows with a token in no document go.

    If the counted words are few, they are sent to all windows: no window's words are dealt by a frequent one then.
    """
    counts = F.broadcast(counts) if few else counts
    spread = windows.select("win", "items", "n", F.posexplode("win").alias("off", "word"))
    rated = spread.join(counts, "word", "left").select(
        "win", "items", "n", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "off").alias("rank")
    )
    least = rated.groupBy("win").agg(
        F.min("rank").alias("rank"), F.any_value("items").alias("items"), F.any_value("n").alias("n")
    )
    return least.where("rank.df > 0").select(
        F.col("rank.word").alias("word"), F.col("rank.off").alias("off"), "n", "win", "items"
    )


def _matches(rows: DataFrame, block: DataFrame) -> DataFrame:
    """One row for each document (its first word is an empty one) and one for each occurrence of a window."""
    start = F.col("pos") - 1 - F.col("off")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("win")
    met = rows.join(F.broadcast(block), (rows.token == block.word) & fits & same, "left")
    return met.where("pos = 0 OR win IS NOT NULL").select(
        "doc_id",
        "h",
        "n_words",
        F.when(F.col("pos") == 0, 1).otherwise(0).alias("is_doc"),
        F.when(F.col("win").isNotNull(), F.struct(start.alias("s"), (start + F.col("n")).alias("e"))).alias("span"),
        "items",
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items array<bigint>), a row for each document row.

    n_hit counts the document's words that lie in any occurrence of any window; items lists whose windows occur.
    """
    windows = item_windows(benchmark, window)
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    few = vocabulary.count() <= BROADCAST_WORDS
    found = materialize(anchors(windows, word_counts(documents, vocabulary, few), few))
    blocks = max(1, -(-found.count() // BLOCK_WINDOWS))
    base = documents.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), words(F.col("text")).alias("w")
    )
    rows = base.select(
        "doc_id",
        "h",
        "w",
        F.size("w").alias("n_words"),
        F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "token"),
    )
    met = reduce(
        DataFrame.unionAll,
        (
            _matches(rows if not b else rows.where("pos > 0"), found.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b))
            for b in range(blocks)
        ),
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("e"), F.lit(0).cast("bigint").alias("t")),
        lambda a, x: F.struct(
            F.greatest(a["e"], x["e"]).alias("e"),
            (a["t"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["e"], x["s"]))).alias("t"),
        ),
        lambda a: a["t"],
    )
    each = met.groupBy("doc_id", "h").agg(
        F.sum("is_doc").alias("copies"),
        F.max("n_words").cast("bigint").alias("n_words"),
        F.collect_set("span").alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return each.select(
        "doc_id",
        F.col("h").alias("text_hash"),
        "n_words",
        covered.alias("n_hit"),
        "items",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without those in which a window of an item occurs; all columns stay."""
    bad = decontaminate(documents, benchmark, window).where("n_hit > 0").select("doc_id", "text_hash").distinct()
    here = documents.alias("d")
    return here.join(
        bad.alias("b"),
        F.col("d.doc_id").eqNullSafe(F.col("b.doc_id"))
        & (F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("b.text_hash")),
        "left_anti",
    )
