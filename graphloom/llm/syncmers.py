"""Document fingerprints of closed syncmers (Edgar, "Syncmers are more sensitive than minimizers", 2021), in DataFrame
operations alone.

A text is cut into units: its words, A-Z lower-cased, and each character by itself in scripts that set no blanks. Of all runs
of K units those are chosen whose least inner run of S units, by hash, is the first or the last one. Whether a run is chosen
depends on nothing outside of it, so a text that is edited elsewhere, moved or embedded keeps its anchors; and of any
K - S + 1 runs in a row at least one is chosen, so no stretch of a text goes without.

An anchor is a number: 32 bits of its run's hash and, in the last hexadecimal digit, how many units behind the anchor before it
it stands (0 for the first). Texts are matched by anchors that have both in common, which are the same run at the same distance behind its
forerunner, wherever in the text. The likeness is twice the number of different anchors in common by the sum of the two
numbers of different anchors (Dice). The fingerprint is the anchors in hexadecimal, in their order, joined by commas; all of a text's anchors are
in it.

A text without a chosen run has one anchor for all of its units, and one without units but not empty one for its characters; so equal
texts have equal fingerprints, and only a null or an empty text has the empty one. Two empty fingerprints have likeness 1, an empty
one and another 0.

Documents follow each other by descending id, null ids last, of equal ids by the text's hash; rows that are equal in both are alike,
so their order doesn't matter. The last is followed by the first, a single one by itself. Rows are dealt to ranges of that order, and the first row of each
range is also given to the range before it, so each row meets its next one in a window of its range and texts are shuffled once.
An empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower

#: Units of an anchor and of the inner runs that decide; an anchor stands at most K - S behind the one before it.
K, S = 5, 2
#: Scripts that set no blanks: Thai and Lao, Myanmar, Khmer, Han and kana.
UNSPACED = r"฀-໿က-႟ក-៿⺀-鿿豈-﫿ｦ-ﾟ\x{20000}-\x{3FFFF}"
UNIT = rf"[{UNSPACED}]|[^\x00-\x2F\x3A-\x60\x7B-\x7F{UNSPACED}]+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _anchor(h: Column, gap: Column) -> Column:
    return F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFFFF)), 4).bitwiseOR(gap.cast("bigint"))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors of a text, array<bigint>; 0 < k - s < 16."""
    width = k - s + 1

    def chosen(runs: Column) -> Column:
        def closed(i: Column) -> Column:
            at = [F.get(runs, i + j) for j in range(width)]
            edge = F.least(at[0], at[-1])
            return edge <= F.least(*at[1:-1]) if width > 3 else edge <= at[1] if width == 3 else F.lit(True)

        return F.filter(F.sequence(F.lit(0), F.size(runs) - width), closed)

    def run_hash(units: Column, runs: Column, i: Column) -> Column:
        whole = range(0, k - s + 1, s)  # inner runs side by side, then the units that are left over
        left = range((k // s) * s, k)
        return F.xxhash64(*[F.get(runs, i + j) for j in whole], *[F.get(units, i + j) for j in left])

    def named(units: Column, runs: Column, places: Column) -> Column:
        def one(place: Column, j: Column) -> Column:
            gap = F.when(j == 0, F.lit(0)).otherwise(place - F.get(places, j - 1))
            return _anchor(run_hash(units, runs, place), gap)

        return F.transform(places, one)

    def of_units(units: Column) -> Column:
        runs = F.transform(
            F.slice(units, 1, F.greatest(F.lit(0), F.size(units) - (s - 1))),
            lambda x, i: F.xxhash64(x, *[F.get(units, i + j) for j in range(1, s)]),
        )
        all_of_it = F.array(_anchor(F.when(F.size(units) > 0, F.xxhash64(units)).otherwise(F.xxhash64(text)), F.lit(0)))

        def of_runs(r: Column) -> Column:
            return _let(chosen(r), lambda p: F.when(F.size(p) > 0, named(units, r, p)).otherwise(all_of_it))

        return F.when(F.size(units) >= k, _let(runs, of_runs)).otherwise(all_of_it)

    units = F.transform(F.regexp_extract_all(ascii_lower(text), F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))
    none = F.array().cast("array<bigint>")
    return F.when(F.coalesce(F.char_length(text), F.lit(0)) == 0, none).otherwise(_let(units, of_units))


def fingerprint(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda a: F.lower(F.hex(a))), ",")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two arrays of anchors."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def _search(bounds: Column, key: Column) -> Column:
    """How many of the sorted bounds are not above a key."""
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(24))])

    def step(at: Column, n: Column) -> Column:
        return F.when((at + n <= F.size(bounds)) & (F.get(bounds, at + n - 1) <= key), at + n).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with `next_<column>` of the row after, by `key` (a column that sorts); the last is followed by the first.

    There are as many ranges as shuffle partitions, times four; their bounds are keys of rows, one each.
    """
    ranges = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.select("key").repartitionByRange(ranges, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("key"))
    bounds = parts.agg(F.sort_array(F.collect_list("key")).alias("_bounds"))  # one row with a key a range
    place = rows.crossJoin(F.broadcast(bounds)).withColumn("_range", _search(F.col("_bounds"), F.col("key")))
    before = F.when(F.col("_range") == 1, F.size("_bounds")).otherwise(F.col("_range") - 1)
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest"))
    guest = F.struct(before.alias("r"), F.lit(1).alias("guest"))
    first = F.get("_bounds", F.col("_range") - 1) == F.col("key")
    dealt = place.select(*rows.columns, F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))).alias("_to"))
    order = Window.partitionBy("_to.r").orderBy("_to.guest", "key")
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    return dealt.select("*", *following).where("_to.guest = 0").drop("_to")


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row.

    The edited text is the text with its last half replaced by as much of the next document's start.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id").isNull(), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)), F.xxhash64(text))
    rows = documents.select("doc_id", text.alias("text"), key.alias("key"), anchors(text).alias("anchors"))
    met = with_next(rows, ["text", "anchors"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.char_length("text") - half), F.left("next_text", half))
    both = met.select("doc_id", F.char_length("text").alias("n_chars"), "anchors", "next_anchors", edited.alias("edited"))
    found = both.select("*", anchors(F.col("edited")).alias("edited_anchors"))
    return found.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
