"""Line dedup by a deletion-neighbourhood join, in DataFrame operations alone.

Lines are sequences of words (cut at ASCII blanks). A line is a copy if an earlier line has the same words, and a near
copy if an earlier line becomes the same by one edit of a word: one put in, taken out or replaced. Lines are ordered
by document id, text hash and place, so the earliest stays; whether a line goes does not depend on whether the earlier
one stays itself. Lines of under `min_words` words always stay.

A word is the unit of an edit, so that a line has as many variants as words: any change within one word is one edit,
and one edit of a character is one of a word unless it puts in or takes out a blank.

1. Equal lines meet on a 96-bit hash; each distinct line keeps its earliest place.
2. A line within one edit of another shares the first or the last half of its words with it. Distinct lines whose
   halves are shared with no other line can't have a partner and leave.
3. The rest emit their deletion neighbourhood, for places i outside the shared half: the line without its i-th word,
   and the line itself as one that lacks a word at i, each as a hash, of the words' hashes, with i. Lines that meet on one are within one edit
   of each other, so each group needs its earliest line alone, not its pairs; the edit distance to that line is then
   verified on the words.

Hashes meet through aggregates and joins that can be split, never in windows, so a line that a third of the
documents share is added up before it is sent. Null texts stay null, empty ones empty; a null id comes before all
others. A long text is cut in lines like others, and a long line is one. Rows of one id are one document's: their lines
at the same place don't make each other copies, and equal rows are treated alike. An empty table gives an empty one;
other columns keep their values, but none may have the name of one that is added.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, new_columns

BLANKS = r"[\x09\x0B-\x0D]"
ADDED = ["n_lines", "n_copies", "n_near", "emptied"]


def tidy(text: Column) -> Column:
    """A text whose blanks other than line ends are spaces."""
    some = reduce(or_, (F.contains(text, F.lit(b)) for b in "\t\x0b\x0c\r"))  # a pattern takes five times as long
    return F.when(some, F.regexp_replace(text, BLANKS, " ")).otherwise(text)


def line_words(line: Column) -> Column:
    return F.array_remove(F.split(line, " ", -1), "")


def once(c: Column) -> Column:
    """The same value out of a generator, so that filters of it take it as it is, where they would compute it again."""
    return F.explode(F.array(c))


def _rest(w: Column, at: Column) -> Column:
    """Words from a place (counted from 1) on."""
    return F.slice(w, at, F.greatest(F.size(w), F.lit(1)))


def neighbourhood(w: Column, i: Column) -> Column:
    """The two hashes of place i (from 0) of words or their hashes: without the i-th one, and as they are with one missing at i."""
    before = F.xxhash64(F.slice(w, F.lit(1), i))
    keys = F.array(F.xxhash64(before, _rest(w, i + 1), i), F.xxhash64(before, _rest(w, i + 2), i))
    return F.when(i < F.size(w), keys).otherwise(F.slice(keys, 1, 1))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by one word put in, taken out or replaced at most."""
    p = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    tail_a, tail_b = _rest(a, p + 1), _rest(b, p + 1)
    from_a, from_b = _rest(a, F.greatest(p, F.lit(1))), _rest(b, F.greatest(p, F.lit(1)))
    d = F.size(a) - F.size(b)
    return (
        F.when(p == 0, True)
        .when(d == 0, tail_a == tail_b)
        .when(d == 1, tail_a == from_b)
        .when(d == -1, from_a == tail_b)
        .otherwise(False)
    )


def _lines(documents: DataFrame, min_words: int) -> DataFrame:
    """A row for each line with enough words: its place, its hash (k1, k2), and hashes p, q, s, t of its halves.

    `at` orders places: the document's id, then the line's number. p and s are of the first and last n/2 words, q and
    t of the first and last (n-1)/2, where that is less: one edit leaves one half of the shorter line whole.
    """
    hashed = documents.select("doc_id", F.xxhash64("text").alias("h"), "text")
    each = hashed.select("doc_id", "h", F.posexplode(F.split(tidy(F.col("text")), "\n", -1)).alias("idx", "line"))
    cut = each.select("doc_id", "h", "idx", once(line_words(F.col("line"))).alias("w")).where(F.size("w") >= min_words)
    w, n = F.col("w"), F.size("w")
    m = F.floor(n / 2).cast("int")
    even = n % 2 == 0
    a, b = F.xxhash64(F.slice(w, F.lit(1), m)), F.xxhash64(F.slice(w, m + 1, n - m))
    tail = F.when(even, b).otherwise(F.xxhash64(F.slice(w, m + 2, m)))
    head2, tail2 = F.xxhash64(F.slice(w, F.lit(1), m - 1)), F.xxhash64(F.slice(w, n - m + 2, m - 1))
    order = F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)")
    return cut.select(
        "doc_id",
        "h",
        "idx",
        (order + F.col("idx")).cast("decimal(32,0)").alias("at"),
        F.xxhash64(n, a, b).alias("k1"),
        F.hash(w).alias("k2"),
        F.xxhash64(F.lit(0), m, a).alias("p"),
        F.xxhash64(F.lit(1), m, tail).alias("s"),
        F.when(even, F.xxhash64(F.lit(0), m - 1, head2)).alias("q"),
        F.when(even, F.xxhash64(F.lit(1), m - 1, tail2)).alias("t"),
    )


def _near(documents: DataFrame, distinct: DataFrame) -> DataFrame:
    """(k1, k2) of the distinct lines that are within one edit of an earlier one."""
    sides = F.array(*(F.struct(F.col(c).alias("half"), F.lit(c in "pq").alias("first")) for c in "psqt"))
    half = distinct.select("k1", "k2", "at", "doc_id", "h", "idx", F.explode(sides).alias("x")).where("x.half IS NOT NULL")
    half = half.select("k1", "k2", "at", "doc_id", "h", "idx", "x.*")
    shared = half.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    some = (
        half.join(shared, "half", "left_semi")
        .groupBy("k1", "k2", "at", "doc_id", "h", "idx")
        .agg(F.max("first").alias("head"), F.min("first").alias("tail"))  # tail: false if a last half is shared
    )
    by_text = some.groupBy(F.col("doc_id").alias("d"), "h").agg(
        F.collect_list(F.struct("k1", "k2", "at", "idx", "head", "tail")).alias("lines")
    )
    texts = documents.select("doc_id", F.xxhash64("text").alias("th"), "text")
    met = texts.join(by_text, texts.doc_id.eqNullSafe(by_text.d) & (F.col("th") == F.col("h")))
    cut = met.select(once(F.split(tidy(F.col("text")), "\n", -1)).alias("all"), "lines").select("all", F.explode("lines").alias("x"))
    found = cut.select("x.*", once(line_words(F.get("all", F.col("x.idx")))).alias("w"))
    # rows may be repeated: the line is wanted once
    own = found.where(F.hash("w") == F.col("k2")).dropDuplicates(["k1", "k2"])
    ranked = own.orderBy("at").select("k1", "k2", "head", "tail", "w", F.monotonically_increasing_id().alias("line"))
    known = materialize(ranked)

    n = F.size("w")
    short = F.floor((n - 1) / 2).cast("int")
    places = F.sequence(F.when(~F.col("tail"), 0).otherwise(short), F.when(F.col("head"), n).otherwise(n - short))
    # each word is hashed once, and not again for each place
    hashed = known.select("line", "head", "tail", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    spread = hashed.select("line", "w", F.explode(places).alias("i"))
    variants = materialize(spread.select("line", F.explode(neighbourhood(F.col("w"), F.col("i"))).alias("key")))
    least = variants.groupBy("key").agg(F.min("line").alias("least"), F.count("*").alias("n")).where("n > 1")
    pairs = variants.join(least, "key").where("line > least").select("line", "least").distinct()
    mine, other = known.select("line", "k1", "k2", "w"), known.select(F.col("line").alias("least"), F.col("w").alias("v"))
    checked = pairs.join(mine, "line").join(other, "least")
    return checked.where(within_one_edit(F.col("w"), F.col("v"))).select("k1", "k2").distinct()


def removals(documents: DataFrame, min_words: int = 5) -> DataFrame:
    """(doc_id, h, copies array<int>, near array<int>): places of the lines to take out of each text."""
    lines = materialize(_lines(documents, min_words))
    halves = [F.max(c).alias(c) for c in "psqt"]
    place = [F.min("at").alias("at"), F.min_by("h", "at").alias("h")]
    grouped = lines.groupBy("k1", "k2").agg(*place, F.count("*").alias("n"), *halves)
    base = F.floor(F.col("at") / F.lit(2**31).cast("decimal(10,0)"))
    distinct = materialize(
        grouped.withColumn("doc_id", F.when(base > -(2**63), base).cast("bigint")).withColumn(
            "idx", F.pmod("at", F.lit(2**31).cast("decimal(10,0)")).cast("int")
        )
    )
    near = _near(documents, distinct).withColumn("near", F.lit(True))
    going = (
        distinct.join(near, ["k1", "k2"], "left")
        .where("n > 1 OR near")
        .select("k1", "k2", F.col("at").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    )
    gone = (
        lines.select("doc_id", "h", "idx", "at", "k1", "k2")
        .join(going, ["k1", "k2"])
        .where("near OR at <> first")
        .select("doc_id", "h", "idx", (F.col("at") != F.col("first")).alias("copy"))
    )
    copies, near_copies = F.when(F.col("copy"), F.col("idx")), F.when(~F.col("copy"), F.col("idx"))
    return gone.groupBy("doc_id", "h").agg(
        F.collect_set(copies).alias("copies"), F.collect_set(near_copies).alias("near")
    )


def dedup_lines(documents: DataFrame, min_words: int = 5) -> DataFrame:
    """All columns, with `text` less its repeated lines, and n_lines, n_copies, n_near and `emptied`.

    A first occurrence that goes for being a near copy counts in n_near; its own copies count in n_copies. A text is
    emptied if lines went and none of min_words words is left.
    """
    new_columns(documents.columns, ADDED)
    gone = removals(documents, min_words).select(F.col("doc_id").alias("d"), "h", F.concat("copies", "near").alias("gone"), "copies", "near")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    id_, text = F.col("row.doc_id"), F.col("row.text")
    met = rows.join(gone, id_.eqNullSafe(F.col("d")) & (F.xxhash64(text) == F.col("h")), "left")
    cut = met.select("row", "copies", "near", "gone", F.split(text, "\n", -1).alias("lines"))
    stay = F.when(F.size("gone") > 0, F.filter("lines", lambda x, i: ~F.array_contains("gone", i))).otherwise(F.col("lines"))
    out = cut.select("row", "copies", "near", "lines", (F.size("gone") > 0).alias("lost"), stay.alias("stay"))
    left = F.exists("stay", lambda x: F.size(line_words(tidy(x))) >= min_words)
    new = F.when(F.col("lost"), F.array_join("stay", "\n")).otherwise(text)

    def count(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0)).cast("bigint")

    return out.select(
        *(new.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in documents.columns),
        F.greatest(count("lines"), F.lit(0)).alias("n_lines"),
        F.greatest(count("copies"), F.lit(0)).alias("n_copies"),
        F.greatest(count("near"), F.lit(0)).alias("n_near"),
        F.when(F.col("lost"), ~left).otherwise(False).alias("emptied"),
    )
