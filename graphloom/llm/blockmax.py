"""Ranked lexical search with block-max pruning (after Mallia, Suel and Tonellotto, SIGIR 2024).

The index is one table. A row is a block of up to BLOCK_DOCUMENTS documents that follow each other as they are stored. It
holds the block's terms as sorted hashes, for each the number of documents with it and the greatest impact of one, and
the forward index: for each document its terms, as places in the block's list, with their impacts. An impact is the part
of a score that doesn't depend on the query; a term's weight comes on top.

A search goes over the index three times, for all queries of a block of queries at once:

1. Documents that hold each query term are added up, which gives the weights.
2. From the maxima alone, each query's bound for every block: the sum of weight times greatest impact. The SEEDS blocks with
   the greatest bounds of all are scored, and the score that `k` documents of these reach is the query's first threshold.
3. Every task sorts the blocks that it holds by the query's bound and scores them until the bound drops below the
   threshold, which rises with what the task finds. Each task gives `k` documents a query at most, and a ranking window
   keeps the best.

No score above the threshold can be in a block whose bound is below it, so the result is exact. Blocks with a bound equal
to the threshold are scored, as a tie is decided by the id. All but the queries' own numbers stays in tasks: a block of queries
has about QUERY_WORDS words, and what the driver collects is a few rows a query or one number a query term.

Terms are told apart by 64 bits of their hash: of a billion different terms in all, some 2,000 query terms would meet one of the
same hash with a chance of one in ten million.

A null text or one without terms is a document without terms: it is never found. Null ids come after all others of an equal score;
a row that is repeated is found as often. Items with a null id or without terms have no rows, and the
different texts of one item are one query. An empty table of either kind gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import byte_words, materialize, words
from graphloom.operators.scratch import release

#: A block ends with so many documents, or with so many different terms of its documents, added up.
BLOCK_DOCUMENTS, BLOCK_ENTRIES = 32, 1 << 16
#: Words of the queries that one search holds, and blocks that it scores for a query's first threshold.
QUERY_WORDS, SEEDS = 1 << 18, 8
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "block bigint, documents array<bigint>, starts binary, entries binary, impacts binary, terms binary, holders binary, maxima binary"


@dataclass
class Index:
    rows: DataFrame
    n_documents: int  # with a term
    n_terms: int  # of all documents, with repeats


def impact(tf: np.ndarray, n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """The part of a document's score for a term that no query changes: tf occurrences among n terms."""
    m = 100 - 75 + (75 * n * n_documents) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _narrow(places: np.ndarray, size: int) -> bytes:
    return places.astype(np.uint16 if size <= 1 << 16 else np.uint32).tobytes()


def _block(number: int, ids: list, terms: list[np.ndarray], impacts: list[np.ndarray]) -> tuple:
    all_terms, all_impacts = np.concatenate(terms), np.concatenate(impacts)
    own, place = np.unique(all_terms, return_inverse=True)
    maxima = np.zeros(len(own), np.int32)
    np.maximum.at(maxima, place, all_impacts)
    starts = np.cumsum([0, *map(len, terms)]).astype(np.int32)
    holders = np.bincount(place, minlength=len(own)).astype(np.int32)
    return (number, ids, starts.tobytes(), _narrow(place, len(own)), all_impacts.tobytes(), own.tobytes(), holders.tobytes(), maxima.tobytes())


def _pack(n_documents: int, n_terms: int):
    types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6]
    names = [x.split()[0] for x in INDEX.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        number = TaskContext.get().partitionId() << 40
        ids, terms, impacts, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counted = Counter(byte_words(text.as_py()))
                tf = np.fromiter(counted.values(), np.int64, len(counted))
                ids.append(doc_id)
                terms.append(np.fromiter(map(xxhash.xxh64_intdigest, counted), np.uint64, len(counted)))
                impacts.append(impact(tf, tf.sum(), n_documents, n_terms).astype(np.int32))
                held += len(counted)
                if len(ids) >= BLOCK_DOCUMENTS or held >= BLOCK_ENTRIES:
                    yield _block(number, ids, terms, impacts)
                    number += 1
                    ids, terms, impacts, held = [], [], [], 0
        if ids:
            yield _block(number, ids, terms, impacts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

    return run


def build_index(documents: DataFrame) -> Index:
    """Index all rows of documents (doc_id, text): one pass counts terms, one packs blocks. Nothing is shuffled."""
    n = F.coalesce(F.size(F.array_remove(F.split("text", SEPARATORS), "")), F.lit(0)).cast("bigint")
    total = documents.agg(F.count_if(n > 0).alias("d"), F.coalesce(F.sum(n), F.lit(0)).alias("l")).first()
    packed = documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_pack(total["d"], total["l"]), INDEX)
    return Index(materialize(packed), total["d"], total["l"])


@dataclass
class Queries:
    items: list
    terms: np.ndarray  # hashes of all their terms, sorted
    term: np.ndarray  # query after query: the place of each of its terms
    repeats: np.ndarray
    starts: np.ndarray  # where each query begins in these
    weights: np.ndarray | None = None  # of each term

    @staticmethod
    def of(rows: list[tuple]) -> Queries:
        """From (item, words) with at least one word each."""
        counted = [Counter(w) for _, w in rows]
        hashed = {w: xxhash.xxh64_intdigest(w.encode()) for c in counted for w in c}
        terms = np.unique(np.fromiter(hashed.values(), np.uint64, len(hashed)))
        flat = np.fromiter((hashed[w] for c in counted for w in c), np.uint64)
        repeats = np.fromiter((n for c in counted for n in c.values()), np.int64)
        starts = np.cumsum([0, *map(len, counted)])
        return Queries([i for i, _ in rows], terms, np.searchsorted(terms, flat), repeats, starts)

    def found(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the query terms, and in a block's sorted terms, of those that both have."""
        at = np.minimum(np.searchsorted(own, self.terms), max(0, len(own) - 1))
        here = np.flatnonzero(own[at] == self.terms) if len(own) else np.zeros(0, np.int64)
        return here, at[here]

    def bounds(self, here: np.ndarray, maxima: np.ndarray) -> np.ndarray:
        """The most that a document of a block can score, for each query."""
        most = np.zeros(len(self.terms), np.int64)
        most[here] = maxima * self.weights[here]
        return np.add.reduceat(most[self.term] * self.repeats, self.starts[:-1])


def _numbers(batch: pa.RecordBatch, column: str, row: int, kind: type) -> np.ndarray:
    """A binary value as numbers, in place."""
    return np.frombuffer(batch.column(column)[row].as_buffer(), kind)


class Block:
    """The impacts of the query terms in the documents of a block, a row of a batch."""

    def __init__(self, batch: pa.RecordBatch, row: int, queries: Queries):
        terms = _numbers(batch, "terms", row, np.uint64)
        self.ids, self.here, at = batch.column("documents")[row].as_py(), *queries.found(terms)
        entries = _numbers(batch, "entries", row, np.uint16 if len(terms) <= 1 << 16 else np.uint32)
        place = np.full(len(terms), -1, np.int32)
        place[at] = np.arange(len(at))
        line = place[entries]
        kept = np.flatnonzero(line >= 0)
        document = np.searchsorted(_numbers(batch, "starts", row, np.int32), kept, side="right") - 1
        self.impacts = np.zeros((len(at), len(self.ids)), np.int32)
        self.impacts[line[kept], document] = _numbers(batch, "impacts", row, np.int32)[kept]

    def scores(self, queries: Queries, q: int) -> np.ndarray:
        a, b = queries.starts[q], queries.starts[q + 1]
        term = queries.term[a:b]
        at = np.minimum(np.searchsorted(self.here, term), max(0, len(self.here) - 1))
        has = self.here[at] == term if len(self.here) else np.zeros(len(term), bool)
        return (queries.weights[term[has]] * queries.repeats[a:b][has]) @ self.impacts[at[has]]


class Best:
    """The best `k` documents of a query so far; the threshold is what the last of them scores."""

    def __init__(self, k: int, threshold: int):
        self.k, self.threshold, self.held = k, threshold, []

    def add(self, scores: np.ndarray, ids: list) -> None:
        new = np.flatnonzero(scores >= self.threshold)
        if len(new):
            self.held += [(-int(scores[i]), ids[i] is None, ids[i] or 0) for i in new]
            if len(self.held) >= self.k:
                self.held = sorted(self.held)[: self.k]
                self.threshold = max(self.threshold, -self.held[-1][0])

    def rows(self) -> list[tuple]:
        return [(None if null else i, -s) for s, null, i in sorted(self.held)[: self.k]]


def _holders(queries: Queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(queries.terms), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                here, at = queries.found(_numbers(batch, "terms", row, np.uint64))
                n[here] += _numbers(batch, "holders", row, np.int32)[at]
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met])], names=["term", "n"])

    return run


def _bounds(batch: pa.RecordBatch, row: int, queries: Queries) -> np.ndarray:
    here, at = queries.found(_numbers(batch, "terms", row, np.uint64))
    return queries.bounds(here, _numbers(batch, "maxima", row, np.int32)[at])


def _tops(queries: Queries, seeds: int):
    """For each query the blocks of a task with the greatest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(queries.items)
        most, block = np.zeros((seeds, n), np.int64), np.zeros((seeds, n), np.int64)
        each = np.arange(n)
        for batch in batches:
            for row, number in enumerate(batch.column("block").to_pylist()):
                bounds = _bounds(batch, row, queries)
                least = most.argmin(axis=0)
                better = np.flatnonzero(bounds > most[least, each])
                most[least[better], better], block[least[better], better] = bounds[better], number
        at, q = np.nonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(block[at, q]), pa.array(most[at, q])], names=["q", "block", "bound"])

    return run


def _rows(found: dict[int, Best]) -> pa.RecordBatch:
    out = [(q, i, s) for q, best in found.items() for i, s in best.rows()]
    cols = [pa.array([r[j] for r in out], pa.int64()) for j in range(3)]
    return pa.RecordBatch.from_arrays(cols, names=["q", "doc_id", "score"])


def _asked(queries: Queries, k: int):
    """The best documents of the blocks that stated queries ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Best] = {}
        for batch in batches:
            for row, asking in enumerate(batch.column("asking").to_pylist()):
                block = Block(batch, row, queries)
                for q in asking:
                    found.setdefault(q, Best(k, 1)).add(block.scores(queries, q), block.ids)
        yield _rows(found)

    return run


#: Bounds that are held at once, and blocks that are sorted, and may be open, together.
BOUNDS, OPEN = 1 << 21, 64


def _pruned(queries: Queries, k: int, thresholds: np.ndarray):
    """Blocks by falling bound, each query until the bound drops below its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Best] = {}
        step = max(1, min(OPEN, BOUNDS // len(queries.items)))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                rows = range(begin, min(begin + step, batch.num_rows))
                bound = np.array([_bounds(batch, row, queries) for row in rows])
                blocks: dict[int, Block] = {}
                for q in np.flatnonzero((bound >= thresholds).any(axis=0)).tolist():
                    best = found.setdefault(q, Best(k, int(thresholds[q])))
                    for at in np.argsort(-bound[:, q], kind="stable").tolist():
                        if bound[at, q] < best.threshold:
                            break
                        if at not in blocks:
                            blocks[at] = Block(batch, rows[at], queries)
                        best.add(blocks[at].scores(queries, q), blocks[at].ids)
        yield _rows(found)

    return run


RESULT = "q bigint, doc_id bigint, score bigint"


def _search(index: Index, queries: Queries, k: int) -> DataFrame:
    """(q, rank, doc_id, score) of a block of queries."""
    rows, spark = index.rows, index.rows.sparkSession
    held = rows.select("terms", "holders").mapInArrow(_holders(queries), "term bigint, n bigint")
    df = np.zeros(len(queries.terms), np.int64)
    for r in held.groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a query term
        df[r["term"]] = r["n"]
    queries.weights = np.array([math.floor(1000 * math.log((2 * index.n_documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    best = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    tops = rows.select("block", "terms", "maxima").mapInArrow(_tops(queries, SEEDS), "q bigint, block bigint, bound bigint")
    seeds = tops.withColumn("r", F.row_number().over(best)).where(F.col("r") <= SEEDS).select("q", "block").collect()  # SEEDS a query
    asking: dict[int, list[int]] = {}
    for r in seeds:
        asking.setdefault(r["block"], []).append(r["q"])
    asked = spark.createDataFrame(list(asking.items()), "block bigint, asking array<bigint>")
    by_rank = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    first = rows.join(F.broadcast(asked), "block").mapInArrow(_asked(queries, k), RESULT)
    thresholds = np.ones(len(queries.items), np.int64)
    for r in first.withColumn("r", F.row_number().over(by_rank)).where(F.col("r") == k).collect():  # one a query
        thresholds[r["q"]] = r["score"]
    found = rows.mapInArrow(_pruned(queries, k, thresholds), RESULT)
    return found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents of each item (item_id, text), or all that score above 0."""
    spark, kind = items.sparkSession, dict(items.dtypes)["item_id"]
    asked = items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.collect_set(words(F.col("text"))).alias("w"))
    asked = asked.select("item_id", F.flatten("w").alias("w")).where("size(w) > 0")
    n = asked.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    parts = -(-n // QUERY_WORDS)
    out = [spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")]
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()  # about QUERY_WORDS words
        if own:
            queries = Queries.of([(r["item_id"], r["w"]) for r in own])
            named = spark.createDataFrame([(q, i) for q, i in enumerate(queries.items)], f"q bigint, item_id {kind}")
            found = _search(index, queries, k).join(F.broadcast(named), "q")  # a row a query
            out.append(materialize(found.select("item_id", "rank", "doc_id", "score")))
    return reduce(DataFrame.unionAll, out)


def rank(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index the documents, rank them for every item, and give the index's files back."""
    index = build_index(documents)
    found = search(index, items, k)
    release(index.rows)
    return found
