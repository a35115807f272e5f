"""N-gram Jaccard join: pairs of documents whose sets of word shingles are alike to `threshold` or more.

1. Documents with equal sets of shingles form a class and are one from here on, with the class's size as weight.
2. Each class gets a MinHash LSH forest: `TREES` paths of `DEPTH` hashes of a byte each. The paths of a tree, sorted, are a
   prefix trie: classes under one node lie side by side.
3. How far matched prefixes are shortened is measured. Query documents (ids divisible by 100, at most `SAMPLE` of them by
   a hash of the id) are compared with all rows by brute force, in the pass that signs the rows, and each link found
   is counted by the deepest node that both share in some tree. Prefixes start at full depth and are shortened, hash by
   hash, until that recall and the one expected at the threshold itself both reach the target (`fit`).
4. The tries are dealt by (tree, prefix of that length) and walked from the deepest nodes up. Two classes under a node
   are passed over if their signatures agree in clearly fewer places than the threshold asks for, or if they are
   connected already. What is left is kept as a forest of edges, not as pairs.
5. Connected components of those edges hold all candidates. Within a component every pair of classes is verified
   on its exact sets, a pair of blocks at a time. A task returns a row for each class (the weight of its links
   and one edge), never the pairs.
6. Components over verified links are the groups: class_id is the least doc_id of the group.

Groups under one prefix or in one component are split into blocks, bounded by rows and by shingles, and each pair of
blocks is a task's unit, so no group lands in one task and nothing is capped. The work within one group of n different
texts still grows with n^2. Tables meet in shuffles; what is broadcast is the sample and the bitmap, both bounded.

Words are those of `words()`; a text of fewer than `WIDTH` words is one shingle, a long one is taken whole. Documents with a
null id, and those without words (null texts too), match nothing: class_id is the own id, n_links 0. Repeated rows of one
id are copies of each other, and rows of one id with different texts are documents like others: their classes are
told apart by their shingles, not by the id. An empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WordHash, byte_words, map_batches, materialize
from graphloom.operators.components import connected_components
from graphloom.operators.relational import shuffled

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.999
TREES, DEPTH = 20, 8
#: Query documents whose links are found by brute force to measure recall, and the longest text of one in characters.
SAMPLE, SAMPLE_TEXT = 2048, 20_000
#: Classes in a block: those under one prefix, and those of one component whose sets are compared (and their shingles).
PREFIX_BLOCK, SET_BLOCK, BLOCK_SHINGLES = 2048, 256, 1 << 18
#: 64-bit words of the bitmap that spares texts the way to a join.
BITMAP_WORDS = 1 << 20
#: Signatures may agree in this much less than the threshold before a pair is passed over: six standard deviations.
SLACK = 0.2

_rng = np.random.Generator(np.random.PCG64(20240229))
MULTIPLY = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
STEP = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * STEP[14]
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, known: WordHash, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = byte_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    code = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        code = _mix(code * STEP[k] + h[k : k + n])
    return np.unique(code)


def signature(codes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles."""
    best = np.full(TREES * DEPTH, np.uint64(2**64 - 1))
    for a in range(0, len(codes), 2048):
        part = codes[a : a + 2048]
        best = np.minimum(best, (part[None, :] * MULTIPLY[:, None] + ADD[:, None]).min(axis=1))
    return best >> np.uint64(32)


def sketch(codes: np.ndarray) -> np.ndarray:
    """The forest's paths, (TREES, DEPTH) bytes."""
    return (signature(codes) & np.uint64(255)).astype(np.uint8).reshape(TREES, DEPTH)


def class_of(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


@dataclass
class Probe:
    """Query documents, ready to be compared with any row by brute force: an index of their shingles."""

    codes: np.ndarray  # sorted distinct shingles of all queries
    first: np.ndarray  # of each: where its queries begin in `query`
    query: np.ndarray
    size: np.ndarray  # shingles of each query
    paths: np.ndarray  # (queries, TREES, DEPTH)
    cls: list[bytes]

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Probe:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        codes, first = np.unique(flat[order], return_index=True)
        paths = np.array([sketch(x) for x in sets], np.uint8).reshape(-1, TREES, DEPTH)
        size = np.array([len(x) for x in sets], np.float64)
        return cls(codes, np.r_[first, len(flat)], row[order], size, paths, [class_of(x) for x in sets])

    def links(self, codes: np.ndarray, own: bytes, paths: np.ndarray, threshold: float) -> list[int]:
        """For each query that is linked to a row and differs from it: the depth of the deepest node both share."""
        if not len(self.codes):
            return []
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        at = at[self.codes[at] == codes]
        if not len(at):
            return []
        queries = np.concatenate([self.query[self.first[k] : self.first[k + 1]] for k in at])
        both = np.bincount(queries, minlength=len(self.size))
        like = np.flatnonzero((both > 0) & _alike(both, self.size, len(codes), threshold))
        like = [q for q in like if self.cls[q] != own]
        deep = np.cumprod(self.paths[like] == paths[None], axis=2).sum(axis=2)
        return deep.max(axis=1).tolist() if like else []


def _alike(both: np.ndarray, m: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """Rounded so that a similarity of exactly the threshold isn't lost to the division."""
    return both >= np.round(threshold * (m + n - both), 6)


def sample(documents: DataFrame) -> Probe:
    """At most SAMPLE query documents, of at most SAMPLE_TEXT characters each."""
    asked = documents.where(
        (F.col("doc_id") % 100 == 0) & F.col("text").isNotNull() & (F.char_length("text") <= SAMPLE_TEXT)
    )
    order = [F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")]
    rows = asked.select("doc_id", "text").dropDuplicates().orderBy(*order).limit(SAMPLE)

    def make():
        known = WordHash()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, known).tobytes() for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(sets, pa.binary())], names=["codes"])

        return run

    got = map_batches(rows, make, "codes binary").toArrow().column("codes").to_pylist()
    return Probe.of([np.frombuffer(x, np.uint64) for x in dict.fromkeys(got) if x])


@dataclass
class Fit:
    """The length of prefixes, with the links of the query documents and the share of them that it reaches."""

    depth: int
    links: int
    recall: float


def fit_depth(deepest: dict[int, int], threshold: float, recall: float) -> Fit:
    """Shorten prefixes until the measured recall and the one expected at the threshold reach the target.

    `deepest` counts the brute-force links by the deepest node that both ends share in some tree.
    """
    links = sum(deepest.values())
    for depth in range(DEPTH, 0, -1):
        measured = sum(n for k, n in deepest.items() if k >= depth) / max(1, links) if links else 1.0
        expected = 1 - (1 - threshold**depth) ** TREES
        if min(measured, expected) >= recall or depth == 1:
            return Fit(depth, links, measured)
    raise AssertionError("unreachable")


def sign_documents(documents: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, Fit]:
    """(doc_id, th bigint, cls binary, n, sign binary) of documents with an id and words, and the fitted depth.

    th is the text's hash, cls that of its set of n shingles, sign the TREES * DEPTH bytes of its paths.
    """
    probe = documents.sparkSession.sparkContext.broadcast(sample(documents))  # bounded: SAMPLE texts

    def make():
        known, queries = WordHash(), probe.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, th, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text"))):
                codes = shingles(text, known)
                if len(codes):
                    paths, cls = sketch(codes), class_of(codes)
                    rows.append((doc_id, th, cls, len(codes), paths.tobytes(), queries.links(codes, cls, paths, threshold)))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
            names = ["doc_id", "th", "cls", "n", "sign", "deepest"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        return run

    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text")
    schema = "doc_id bigint, th bigint, cls binary, n int, sign binary, deepest array<int>"
    signed = materialize(map_batches(rows, make, schema))
    found = signed.select(F.explode("deepest").alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()  # DEPTH + 1
    return signed.drop("deepest"), fit_depth({r.k: r.n for r in found}, threshold, recall)


def in_cells(members: DataFrame, group: str, blocks: Column, *order: Column | str) -> DataFrame:
    """Members of each group dealt to the pairs of its blocks: adds cell struct<i,j> and own, its block.

    A group of one block is one cell. A member of one of k blocks gets k rows.
    """
    k = F.greatest(F.lit(1), blocks).cast("int")
    own = F.pmod(F.xxhash64("id"), k).cast("int")
    dealt = members.withColumn("_k", k).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    return (
        dealt.select("*", other.alias("_o"))
        .withColumn("i", F.least("own", "_o"))
        .withColumn("j", F.greatest("own", "_o"))
        .drop("_k", "_o")
        .repartition(group, "i", "j")
        .sortWithinPartitions(group, "i", "j", *order, "id")
    )


def cells(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Whole cells of a sorted partition, some at a time: columns, and the bounds of each cell."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        starts = _starts(t, group)
        cut = int(starts[-1]) if len(starts) else 0  # the last cell may go on in the next batch
        if cut:
            yield _columns(t.slice(0, cut)), starts
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield _columns(rest), np.r_[_starts(rest, group), rest.num_rows]


def _starts(t: pa.Table, group: str) -> np.ndarray:
    keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in (group, "i", "j")])
    if not keys.shape[1]:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    def numpy(c: str, kind: pa.DataType) -> np.ndarray:
        if pa.types.is_binary(kind) or pa.types.is_string(kind):
            return np.array(t.column(c).to_pylist(), object)
        return t.column(c).to_numpy()

    return {c: numpy(c, kind) for c, kind in zip(t.schema.names, t.schema.types)}


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = int(parent[x])
    return x


def _forest(batches: Iterator[pa.RecordBatch], threshold: float, floor: int) -> Iterator[pa.RecordBatch]:
    """Edges that connect the classes that may be alike under the nodes of each trie, the deepest nodes first."""
    for c, bounds in cells(batches, "key"):
        n, own, ids = c["n"].astype(np.float64), c["own"], c["id"]
        sign = np.frombuffer(b"".join(c["sign"]), np.uint8).reshape(len(ids), -1)
        path = sign.reshape(len(ids), TREES, DEPTH)[np.arange(len(ids)), c["tree"]]
        split = np.zeros(len(ids), bool)
        split[bounds[:-1]] = True
        apart = c["i"] != c["j"]
        parent = np.arange(len(ids))
        label = parent.copy()
        src, dst = [], []
        for depth in range(DEPTH, floor - 1, -1):
            node = np.cumsum(split | np.r_[True, (path[1:, :depth] != path[:-1, :depth]).any(axis=1)])
            at = np.arange(len(ids))
            for k in range(1, len(ids)):
                at = at[at + k < len(ids)]
                at = at[node[at] == node[at + k]]
                if not len(at):
                    break
                a, b = at, at + k
                new = label[a] != label[b]
                new &= ~apart[a] | (own[a] != own[b])
                new &= np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])
                a, b = a[new], b[new]
                for s in range(0, len(a), 1 << 15):
                    x, y = a[s : s + (1 << 15)], b[s : s + (1 << 15)]
                    like = (sign[x] == sign[y]).mean(axis=1) >= threshold - SLACK
                    for p, q in zip(x[like], y[like]):
                        p, q = _root(parent, int(p)), _root(parent, int(q))
                        if p != q:
                            parent[max(p, q)] = min(p, q)
                            src.append(ids[p])
                            dst.append(ids[q])
                if len(a):
                    while True:  # the rows' labels follow the merged roots
                        up = parent[parent]
                        if (up == parent).all():
                            break
                        parent = up
                    label = parent
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    m = len(sets)
    if m <= 8:
        out = np.zeros((m, m))
        for i in range(m):
            for j in range(i + 1, m):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    row, code = row[shared], code[shared]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    code = np.cumsum(np.r_[0, code[1:] != code[:-1]]) if len(code) else code
    out = np.zeros((m, m), np.float32)
    n = int(code[-1]) + 1 if len(code) else 0
    for a in range(0, n, 4096):
        lo, hi = np.searchsorted(code, (a, a + 4096))
        x = np.zeros((m, min(4096, n - a)), np.float32)
        x[row[lo:hi], code[lo:hi] - a] = 1
        out += x @ x.T
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, codes) of the texts that have the shingles of their class."""
    known = WordHash()
    for batch in batches:
        ids, sets = [], []
        for id_, cls, text in zip(*(batch.column(c).to_pylist() for c in ("id", "cls", "text"))):
            codes = shingles(text, known)
            if class_of(codes) == cls:
                ids.append(id_)
                sets.append(codes.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "codes"])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each class of a cell: the documents it is linked to there, and an edge to another of its links."""
    for c, bounds in cells(batches, "component"):
        ids, weight, to = [], [], []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in c["codes"][lo:hi]]
            size = np.array([len(s) for s in sets], np.float64)
            like = _alike(_overlaps(sets), size[:, None], size[None, :], threshold)
            np.fill_diagonal(like, False)
            if c["i"][lo] != c["j"][lo]:
                like &= c["own"][lo:hi][:, None] != c["own"][lo:hi][None, :]
            links = like @ c["size"][lo:hi].astype(np.int64)
            parent = np.arange(hi - lo)
            for x, y in zip(*np.nonzero(np.triu(like))):
                p, q = _root(parent, int(x)), _root(parent, int(y))
                if p != q:
                    parent[max(p, q)] = min(p, q)
            for x in np.flatnonzero(links):
                ids.append(c["id"][lo + x])
                weight.append(links[x])
                to.append(c["id"][lo + _root(parent, int(x))])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(weight, pa.int64()), pa.array(to, pa.int64())],
            names=["id", "links", "root"],
        )


def _may_be(texts: DataFrame, some: DataFrame) -> DataFrame:
    """The texts less most of those that aren't among some (doc_id, th), so that few are sent to a join.

    A bitmap of `BITMAP_WORDS` * 64 bits at most is broadcast; a row stays if its bit is set.
    """
    bit = F.pmod(F.xxhash64("doc_id", "th"), F.lit(BITMAP_WORDS * 64))
    word, place = F.shiftright(bit, 6), (bit % 64).cast("int")
    one = F.expr("shiftleft(1L, place)")
    bitmap = some.select(word.alias("word"), place.alias("place")).groupBy("word").agg(F.bit_or(one).alias("bits"))
    rows = texts.withColumn("word", word).withColumn("place", place).join(F.broadcast(bitmap), "word")
    return rows.where(one.bitwiseAND(F.col("bits")) != 0).select("doc_id", "th", "text")


def _grouped(documents: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(doc_id, th, class_id, n_links, first) of document rows with an id and words.

    th is the text's hash; `first` tells the row that stands for its group, the one of the least (doc_id, th).
    """
    signed, fit = sign_documents(documents, threshold, recall)
    by_class = signed.groupBy("cls").agg(
        F.min(F.struct("doc_id", "th")).alias("row"),
        F.count("*").alias("size"),
        F.any_value("n").alias("n"),
        F.any_value("sign").alias("sign"),
    )
    classes = materialize(by_class.select("*", F.monotonically_increasing_id().alias("id")))

    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    prefix = F.expr(f"substring(sign, {DEPTH} * tree + 1, {fit.depth})")
    under = classes.select("id", "sign", tree.alias("tree")).select("id", "tree", F.xxhash64("tree", prefix).alias("key"))
    met = under.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = under.join(shuffled(met), "key").join(shuffled(classes.select("id", "n", "sign")), "id")
    path = F.expr(f"substring(sign, {DEPTH} * tree + 1, {DEPTH})")
    edges = in_cells(members, "key", F.ceil(F.col("m") / PREFIX_BLOCK), path).mapInArrow(
        lambda b: _forest(b, threshold, fit.depth), "src bigint, dst bigint"
    )
    candidates = connected_components(edges)

    some = materialize(candidates.join(shuffled(classes.select("id", "row.*", "cls", "size", "n")), "id"))
    sizes = some.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("all_n"))
    texts = documents.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text")
    texts = _may_be(texts, some)
    wanted = texts.join(shuffled(some.select("doc_id", "th", "id", "cls")), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    sets = wanted.select("id", "cls", "text").mapInArrow(_sets, "id bigint, codes binary")
    held = some.select("id", "component", "size").join(shuffled(sizes), "component").join(shuffled(sets), "id")
    blocks = F.greatest(F.ceil(F.col("m") / SET_BLOCK), F.ceil(F.col("all_n") / BLOCK_SHINGLES))
    verified = materialize(
        in_cells(held, "component", blocks).mapInArrow(
            lambda b: _verify(b, threshold), "id bigint, links bigint, root bigint"
        )
    )
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(verified, "id", "root")
    led = groups.join(shuffled(some.select("id", F.struct("doc_id", "th").alias("row"))), "id")
    leaders = led.groupBy("component").agg(F.min("row").alias("leader"))
    linked = led.join(shuffled(leaders), "component").join(shuffled(links), "id").select("id", "leader", "links")

    named = classes.join(shuffled(linked), "id", "left").select(
        "cls",
        F.coalesce("leader", "row").alias("leader"),
        (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    return signed.select("doc_id", "th", "cls").join(shuffled(named), "cls").select(
        "doc_id",
        "th",
        F.col("leader.doc_id").alias("class_id"),
        "n_links",
        (F.struct("doc_id", "th") == F.col("leader")).alias("first"),
    )


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each document row.

    n_links is the number of other documents whose shingles are alike to the threshold or more.
    """
    found = _grouped(documents, threshold, recall).select("doc_id", "class_id", "n_links")
    alone = documents.where(F.col("doc_id").isNull() | ~_has_word(F.col("text"))).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")
    )
    return found.unionAll(alone)


def _has_word(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(False))


def keep_first(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One document of each group, the one with the least id (and text hash); those that match nothing stay.

    A row that is repeated with its id and text is kept once.
    """
    found = materialize(_grouped(documents, threshold, recall).groupBy("doc_id", "th").agg(F.any_value("first").alias("first"), F.count("*").alias("n")))
    gone, kept = found.where("NOT first").alias("g"), documents.alias("d")
    th = F.xxhash64("d.text")
    kept = kept.join(shuffled(gone), (F.col("d.doc_id") == F.col("g.doc_id")) & (th == F.col("g.th")), "left_anti")
    again = found.where("first AND n > 1").select("doc_id", "th").alias("g")
    if again.isEmpty():
        return kept
    match = (F.col("d.doc_id") == F.col("g.doc_id")) & (th == F.col("g.th"))
    own = F.struct(*(F.col(f"d.`{c}`") for c in documents.columns)).alias("row")
    once = kept.alias("d").join(shuffled(again), match).select(own, "g.*").dropDuplicates(["doc_id", "th"])
    return kept.alias("d").join(shuffled(again), match, "left_anti").unionAll(once.select("row.*"))
