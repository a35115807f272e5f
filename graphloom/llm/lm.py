"""Language-model scoring by cross-entropy difference.

Two word n-gram models of one order, one of target documents and one of all documents, are counted alike over one
shared vocabulary: the words of all documents (`words()`), hashed into `PLACES` places, with a mark for the start and
one for the end of a text. The score of a document is the mean over its tokens of the loss under the target model less
that under the background model; lower is closer to the target. Loss of a token x after a context, with counts c that
leave out the document itself (no text is scored by what it taught), a prior weight mu and N tokens in all:

    p1(x) = (c(x) + mu / PLACES) / (N + mu)     p2(x|b) = (c(bx) + mu p1(x)) / (c(b) + mu)
    and so on up to the order, each with the one below as its prior

Every n-gram of every document is counted, and what is counted grows with the documents, so no table of it is ever in
one place:

1. Documents are packed in slices of about `SLICE_TOKENS` tokens, which are written; the targets' ids meet the slices'
   ids there, not the texts. A slice adds up its own n-grams and
   sends each one once, with its counts, to the bucket of the n-gram's hash: one that all documents share comes once a
   slice.
2. A bucket adds up what it got and answers each slice with the counts of all others, in the order that it was asked.
3. A slice has the counts of all its n-grams now and scores its tokens.

Buckets hold about `BUCKET_BYTES` of text each, however much there is. Within one, n-grams are told apart by 32 bits of
their hash: of a million in a bucket about one in 4,000 shares its counts with another.

A null text or one without words has no tokens and null losses. A document is a target if its id is among the targets,
null ids never are. Repeated rows teach each other. Texts are taken whole: a slice is never less than a text. Rows are returned
one for one, an empty table gives an empty one, and other columns keep their values; the columns added may not be there
before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WordHash, byte_words, materialize, new_columns, runs
from graphloom.operators.scratch import release

#: With the marks, which no word is, a token has 24 bits.
PLACES = (1 << 24) - 2
START, END = PLACES, PLACES + 1
SLICE_TOKENS, BUCKET_BYTES = 1 << 18, 4 << 20
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
ADDED = ["n_tokens", "ce_background", "ce_target", "score"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP[1]
    h = (h ^ (h >> np.uint64(29))) * _STEP[2]
    return h ^ (h >> np.uint64(32))


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """Numbers as planes of bytes, the lowest `width` of them: those of small numbers are zeros, which compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(b: bytes, width: int = 8) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return out.view("<i8").ravel()


def _encode(n: np.ndarray, target: np.ndarray) -> bytes:
    """Counts with the part of each that targets have: a byte each, a bit where the count is 1 or 0, more for large ones."""
    many, large = n > 1, n >= 255
    parts = [np.minimum(n, 255), np.minimum(target[many], 255), np.packbits(target[~many] > 0)]
    return b"".join(x.astype(np.uint8).tobytes() for x in parts) + np.stack([n[large], target[large]]).astype("<i8").tobytes()


def _decode(b: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b, np.uint8)
    n, target = raw[:size].astype(np.int64), np.zeros(size, np.int64)
    many, large = n > 1, n == 255
    k = int(many.sum())
    bits = size + k + -(-(size - k) // 8)
    target[many] = raw[size : size + k]
    target[~many] = np.unpackbits(raw[size + k : bits])[: size - k]
    n[large], target[large] = np.frombuffer(b[bits:], "<i8").reshape(2, -1)
    return n, target


class Slice:
    """Some documents' tokens, each document closed by END, and the n-grams that end at each token.

    grams are the distinct n-grams in the order of (bucket, hash); at[k] are the places in it of each token's n-gram of
    k + 1 tokens.
    """

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, order: int, buckets: int):
        self.sizes = sizes  # tokens of each document, END included; 0 without words
        self.document = np.repeat(np.arange(len(sizes)), sizes)
        self.begins = np.zeros(len(tokens), bool)
        self.begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        back = tokens.astype(np.uint64)
        codes = [_mix(back * _STEP[0] + np.uint64(1))]
        for k in range(2, order + 1):
            back = np.where(self.begins, np.uint64(START), np.r_[np.uint64(START), back[:-1]])
            codes.append(_mix(codes[-1] ^ _mix(back * _STEP[0] + np.uint64(k))))
        codes = np.concatenate(codes)
        found, at = np.unique(codes, return_inverse=True)
        del codes, back
        bucket = (found % np.uint64(buckets)).astype(np.int32)
        sort = np.argsort(bucket, kind="stable")
        rank = np.empty(len(sort), np.int32)
        rank[sort] = np.arange(len(sort), dtype=np.int32)
        self.at = rank[at].reshape(order, -1)
        self.bucket = bucket[sort]
        self.grams = (found[sort] // np.uint64(buckets)).astype(np.uint32)

    def counts(self, kept: np.ndarray | None = None) -> np.ndarray:
        """How often each n-gram ends at one of the tokens that are kept."""
        at = self.at if kept is None or kept.all() else self.at[:, kept]
        return np.bincount(at.ravel(), minlength=len(self.grams))

    def edges(self) -> np.ndarray:
        """Where each bucket's n-grams begin, and the end of the last one's."""
        return np.r_[np.flatnonzero(np.diff(self.bucket, prepend=-1)), len(self.grams)]

    def own(self) -> np.ndarray:
        """(order, tokens): how often the n-gram at each token occurs in its own document."""
        out = np.empty(self.at.shape, np.int64)
        for k, at in enumerate(self.at):
            _, place, n = np.unique(at + self.document * max(1, len(self.grams)), return_inverse=True, return_counts=True)
            out[k] = n[place]
        return out

    def losses(self, total: np.ndarray, own: np.ndarray, n: int, documents: int, member: np.ndarray, mu: float) -> np.ndarray:
        """Loss of each token under the model of these totals, less the document itself where it is a member."""
        leave = member[self.document]
        context = n - np.where(leave, self.sizes[self.document], 0)
        p = 1 / PLACES
        for at, o in zip(self.at, own):
            c = total[at] - np.where(leave, o, 0)
            p = (c + mu * p) / (context + mu)
            # the next context is the n-gram that ends a token earlier; each text starts once
            context = np.where(self.begins, documents - leave, np.r_[0, c[:-1]])
        return -np.log(p)


def _pack(keys: list[str]):
    """Slices of the documents, a row each: the other columns, and tokens."""

    def close(slice_id: int, docs: list[pa.StructArray], texts: list[str | None]) -> pa.RecordBatch:
        hashed = WordHash()
        ids, sizes = [], []
        for text in texts:
            w = byte_words(text)
            if w:
                ids.append(np.fromiter(map(hashed.__getitem__, w), np.uint64, len(w)) % np.uint64(PLACES))
                ids.append(np.array([END], np.uint64))
            sizes.append(len(w) + bool(w))
        tokens = np.concatenate([*ids, np.zeros(0, np.uint64)])
        rows = pa.concat_arrays(docs)
        listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        arrays = [pa.array([slice_id]), listed, pa.array([sizes], pa.list_(pa.int64())), pa.array([_planes(tokens, 3)], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["slice", "docs", "sizes", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_id = TaskContext.get().partitionId() << 40
        docs: list[pa.StructArray] = []
        texts: list[str | None] = []
        held = 0
        for batch in batches:
            own = [batch.column(i) for i in range(len(keys))] or [pa.nulls(batch.num_rows, pa.int8())]
            rows = pa.StructArray.from_arrays(own, names=[f"k{i}" for i in range(len(own))])
            begin = 0
            for i, text in enumerate(batch.column(len(keys))):
                t = text.as_py()
                texts.append(t)
                held += len(t or "") // 6 + 1  # about its tokens
                if held >= SLICE_TOKENS:
                    docs.append(rows.slice(begin, i + 1 - begin))
                    yield close(slice_id, docs, texts)
                    slice_id, docs, texts, held, begin = slice_id + 1, [], [], 0, i + 1
            if begin < batch.num_rows:
                docs.append(rows.slice(begin))
        if texts:
            yield close(slice_id, docs, texts)

    return run


def _open(row: dict, order: int, buckets: int) -> tuple[Slice, np.ndarray]:
    sizes = np.array(row["sizes"], np.int64)
    member = np.zeros(len(sizes), bool)
    member[row["targets"] or []] = True
    return Slice(_numbers(row["tokens"], 3), sizes, order, buckets), member


def _ask(order: int, buckets: int):
    """A row for each bucket that a slice asks: the n-grams' hashes and the slice's own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                s, member = _open(row, order, buckets)
                n, target = s.counts(), s.counts(member[s.document])
                edges = s.edges().tolist()
                spans = list(zip(edges[:-1], edges[1:]))
                cols = [
                    pa.array([row["slice"]] * len(spans), pa.int64()),
                    pa.array([int(s.bucket[a]) for a, _ in spans], pa.int64()),
                    pa.array([s.grams[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([_encode(n[a:b], target[a:b]) for a, b in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["slice", "bucket", "grams", "counts"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice that asks a bucket: how often its n-grams occur in other slices."""
    for t in runs(batches, "bucket"):
        grams = [np.frombuffer(x, np.uint32) for x in t.column("grams").to_pylist()]
        _, at = np.unique(np.concatenate(grams), return_inverse=True)
        cuts = np.cumsum([len(g) for g in grams])[:-1]
        counts = [_decode(c, len(g)) for c, g in zip(t.column("counts").to_pylist(), grams)]
        others = []
        for k in range(2):
            own = np.concatenate([c[k] for c in counts])
            total = np.zeros(int(at.max()) + 1, np.int64)
            np.add.at(total, at, own)
            others.append(np.split(total[at] - own, cuts))
        who = [t.column(c).combine_chunks() for c in ("slice", "bucket")]
        yield pa.RecordBatch.from_arrays(
            [*who, pa.array([_encode(n, target) for n, target in zip(*others)], pa.binary())], names=["slice", "bucket", "counts"]
        )


def _score(totals: list[int], order: int, buckets: int, keys: list[str], mu: float):
    n_tokens, n_target, n_docs, n_target_docs = totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "slice"):
            answers = t.slice(1)
            s, member = _open({c: t.column(c)[0].as_py() for c in ("targets", "sizes", "tokens")}, order, buckets)
            own, everyone = s.own(), np.ones(len(member), bool)
            edges, others = s.edges(), np.empty((2, len(s.grams)), np.int64)
            for a, b, c in zip(edges[:-1], edges[1:], answers.column("counts"), strict=True):
                others[:, a:b] = _decode(c.as_py(), b - a)
            losses = []
            for total, who, n, documents in zip(others, (everyone, member), (n_tokens, n_target), (n_docs, n_target_docs)):
                losses.append(s.losses(total + s.counts(who[s.document]), own, n, documents, who, mu))
            background, target = losses
            cols = [pa.array(np.maximum(s.sizes - 1, 0))]
            for x in (background, target, target - background):  # the last: loss differences of the tokens
                mean = np.bincount(s.document, x, len(s.sizes)) / np.maximum(s.sizes, 1)
                cols.append(pa.array(mean, pa.float64(), mask=s.sizes == 0))
            docs = t.column("docs").combine_chunks()[0].values
            yield pa.RecordBatch.from_arrays([*(docs.flatten() if keys else []), *cols], names=[*keys, *ADDED])

    return run


def score(
    documents: DataFrame, targets: DataFrame | None = None, key: str = "doc_id", order: int = 2, mu: float = 5.0
) -> DataFrame:
    """The documents' columns but the text, with n_tokens, ce_background, ce_target and their difference, score.

    targets has the ids of the target documents in its column `key`. n_tokens counts words; the losses are means over
    these and the end of the text.
    """
    keys = [c for c in documents.columns if c != "text"]
    new_columns(keys, ADDED)
    kinds = dict(documents.dtypes)
    size = documents.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = 1 + size // BUCKET_BYTES
    docs = f"array<struct<{', '.join(f'k{i}: {kinds[c]}' for i, c in enumerate(keys)) or 'k0: tinyint'}>>"
    packed = materialize(
        documents.select(*keys, "text").mapInArrow(_pack(keys), f"slice bigint, docs {docs}, sizes array<bigint>, tokens binary")
    )
    if targets is None:
        marked = packed.withColumn("targets", F.lit(None).cast("array<int>"))
    else:
        ids = packed.select("slice", F.posexplode(F.transform("docs", lambda d: d[f"k{keys.index(key)}"])).alias("at", "id"))
        known = targets.select(F.col(key).alias("id")).distinct()
        flags = ids.join(known, "id", "left_semi").groupBy("slice").agg(F.collect_list("at").alias("targets"))
        marked = materialize(packed.join(flags, "slice", "left"))
        release(packed)
    its = F.transform(F.coalesce("targets", F.array().cast("array<int>")), lambda i: F.get("sizes", i))
    sums = marked.agg(*(F.coalesce(F.sum(f(x)), F.lit(0)) for f, x in ((_total, F.col("sizes")), (_total, its), (_filled, F.col("sizes")), (_filled, its)))).first()
    asked = marked.select("slice", "targets", "sizes", "tokens").mapInArrow(
        _ask(order, buckets), "slice bigint, bucket bigint, grams binary, counts binary"
    )
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _answer, "slice bigint, bucket bigint, counts binary"
    )
    heads = marked.select("slice", F.lit(-1).cast("bigint").alias("bucket"), "docs", "targets", "sizes", "tokens")
    both = heads.unionByName(answers, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "bucket")
    out = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n_tokens bigint", *(f"{n} double" for n in ADDED[1:])])
    return both.mapInArrow(_score([int(x) for x in sums], order, buckets, keys, mu), out)


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _filled(sizes: Column) -> Column:
    return F.size(F.filter(sizes, lambda x: x > 0))
