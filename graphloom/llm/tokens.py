"""Token counts that follow edits.

A document's pre-tokens are the leaves of a tree that holds the sums of their characters and tokens. An edit
re-encodes the pre-tokens it touches and those near enough to have looked at the changed text, until a new boundary
falls on an old one; the sums above them are then updated and all else stays as it was.

Why that is exact: where a match of the pre-token pattern ends depends on the text from its start on, and on no more
than LOOK characters past its end. So pre-tokens that end more than LOOK characters before an edit stay, and once a
boundary behind the edit coincides with an old one, all later pre-tokens stay too.

Trees are kept: `segment` gives each document its leaves (their characters and tokens) as columns that can be written
like any others, and `apply_edits` takes them from there. It encodes what edits touch and nothing else, and gives back
the leaves of the edited text for the next edits.

An edit is (start, end, text) in code points of the text as earlier edits left it; places outside it are moved to
its ends. A null text is an empty one, a long one is taken whole; a null or empty list of edits changes nothing. Repeated
rows are counted alike, an empty table gives an empty one, and rows are returned one for one. Other columns keep their
values, but none may have the name of one that is added.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from graphloom.llm.common import map_batches, new_columns

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that this vocabulary was made with (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters past its end that a match may look at: a blank and what follows it, or the rest of "'re".
LOOK = 2
LEAVES = 64
CACHE = 1 << 20


class Counter(dict):
    """Tokens of each pre-token, remembered; cleared when it has grown to CACHE entries."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[piece] = len(self.encoding._encode_single_piece(piece.encode("utf-8", "surrogatepass")))
        return n


class TokenTree:
    """Pre-tokens in blocks of about LEAVES, below a binary tree of (characters, tokens) sums."""

    def __init__(self, pieces: list[str], counter: Counter, counts: list[int] | None = None):
        self.counter = counter
        self.encoded = 0  # pre-tokens that edits made it encode
        self._build(pieces, list(map(counter.__getitem__, pieces)) if counts is None else counts)

    @classmethod
    def of_leaves(cls, text: str, chars: list[int], counts: list[int], counter: Counter) -> TokenTree:
        """The tree of a text whose leaves are known: nothing is encoded."""
        ends = list(accumulate(chars))
        return cls([text[e - n : e] for e, n in zip(ends, chars)], counter, counts)

    def _build(self, pieces: list[str], counts: list[int]) -> None:
        starts = range(0, len(pieces) or 1, LEAVES)
        self.blocks = [pieces[a : a + LEAVES] for a in starts]
        self.counts = [counts[a : a + LEAVES] for a in starts]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        blank = [0] * (self.width - len(self.blocks))
        self.chars = [0] * self.width + [sum(map(len, b)) for b in self.blocks] + blank
        self.tokens = [0] * self.width + list(map(sum, self.counts)) + blank
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _update(self, block: int) -> None:
        i = self.width + block
        self.chars[i] = sum(map(len, self.blocks[block]))
        self.tokens[i] = sum(self.counts[block])
        i //= 2
        while i:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(map("".join, self.blocks))

    def locate(self, at: int) -> tuple[int, int, int]:
        """Block, leaf and first character of the leaf that holds character `at`; the end for one past the last."""
        if at >= self.n_chars:
            return len(self.blocks) - 1, len(self.blocks[-1]), self.n_chars
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if at >= begin + self.chars[i]:
                begin += self.chars[i]
                i += 1
        block = i - self.width
        for leaf, piece in enumerate(self.blocks[block]):
            if at < begin + len(piece):
                return block, leaf, begin
            begin += len(piece)
        raise AssertionError("sums and leaves differ")

    def _after(self, block: int, leaf: int):
        """The leaves from one on, with their places."""
        while block < len(self.blocks):
            for k in range(leaf, len(self.blocks[block])):
                yield block, k, self.blocks[block][k]
            block, leaf = block + 1, 0

    def edit(self, start: int, end: int, text: str) -> None:
        start = min(max(0, start), self.n_chars)
        end = min(max(start, end), self.n_chars)
        b0, l0, begin = self.locate(max(0, start - LOOK)) if self.n_chars else (0, 0, 0)
        old = self._after(b0, l0)
        taken: list[str] = []  # old leaves from there on
        ends: dict[int, tuple[int, int]] = {}  # where each ends, with the place of the leaf behind it
        at, more = begin, 8
        while True:
            done = True
            for block, leaf, piece in old:
                taken.append(piece)
                at += len(piece)
                ends[at] = (block, leaf + 1)
                if at >= end:
                    more -= 1
                    if more <= 0:
                        done = False
                        break
            joined = "".join(taken)
            fresh = joined[: start - begin] + text + joined[end - begin :]
            shift = len(text) - (end - start)
            pieces, place = [], begin
            behind = None
            for piece in self.counter.find(fresh):
                pieces.append(piece)
                place += len(piece)
                sure = done or place + LOOK <= begin + len(fresh)
                if sure and place >= start + len(text) and place - shift in ends:
                    behind = ends[place - shift]
                    break
                if not sure:
                    break
            if behind or done:
                break
            more = 2 * len(taken)
        if behind is None:  # nothing of the text is left behind the edit
            behind = ends.get(at, (b0, l0))
        self.encoded += len(pieces)
        b1, l1 = behind
        for parts, new in ((self.blocks, pieces), (self.counts, list(map(self.counter.__getitem__, pieces)))):
            parts[b0] = parts[b0][:l0] + new + parts[b1][l1:]
            for b in range(b0 + 1, b1 + 1):
                parts[b] = []
        if len(self.blocks[b0]) > 4 * LEAVES:
            self._build([x for b in self.blocks for x in b], [x for b in self.counts for x in b])
        else:
            for b in range(b0, b1 + 1):
                self._update(b)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Columns of a tree's leaves, and of the counts that edits give.
LEAF_COLUMNS = ["leaf_chars", "leaf_tokens", "n_tokens"]
COUNTS = ["n_pretokens", "n_tokens", "n_edits", "n_tokens_after", "n_reencoded"]


def _counter(documents: DataFrame, vocabulary: str):
    """Makes a Counter in a task; the vocabulary is read once, on the driver, and its ranks are sent to the tasks."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    return lambda: Counter(ranks.value)


def _lists(column: pa.ListArray) -> Iterator[list[int]]:
    """The lists of a column, without a Python object for each number that isn't looked at."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return (values[a:b].tolist() for a, b in zip(ends[:-1], ends[1:]))


def segment(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with leaf_chars and leaf_tokens, array<int>, of their pre-tokens, and n_tokens."""
    keys = documents.columns
    new_columns(keys, LEAF_COLUMNS)
    kinds = dict(documents.dtypes)
    counter_of = _counter(documents, vocabulary)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        counter = counter_of()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            leaves = [counter.find(t or "") for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, leaves)], dtype=np.int64)
            flat = list(chain.from_iterable(leaves))
            chars = np.fromiter(map(len, flat), np.int32, len(flat))
            counts = np.fromiter(map(counter.__getitem__, flat), np.int32, len(flat))
            sums = np.r_[0, np.cumsum(counts, dtype=np.int64)]
            offsets = pa.array(ends, pa.int32())
            cols = [*(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (chars, counts)), pa.array(sums[ends[1:]] - sums[ends[:-1]])]
            return pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*keys, *LEAF_COLUMNS])

        return run

    schema = [*(f"`{k}` {kinds[k]}" for k in keys), "leaf_chars array<int>, leaf_tokens array<int>, n_tokens bigint"]
    return map_batches(documents, make, ", ".join(schema))


def apply_edits(trees: DataFrame, edits: str = "edits", vocabulary: str = VOCABULARY, keep: bool = True) -> DataFrame:
    """What edits do to segmented documents: array<struct<start:int,end:int,text:string>>, applied in order.

    Returns the other columns with n_pretokens and n_tokens before, n_edits, n_tokens_after, and n_reencoded, the pre-tokens
    that the edits made it encode; and, to keep them, the edited text with its leaves (leaf_chars, leaf_tokens).
    """
    keys = [c for c in trees.columns if c not in ("text", edits, *LEAF_COLUMNS)]
    kept = ["text", "leaf_chars", "leaf_tokens"] if keep else []
    new_columns(keys, [*COUNTS, *kept])
    kinds = dict(trees.dtypes)
    counter_of = _counter(trees, vocabulary)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        counter = counter_of()

        def one(text: str | None, chars: list[int], counts: list[int], log: list[dict] | None) -> tuple:
            log = [e for e in log or [] if e is not None]
            if not log:
                return len(chars), sum(counts), 0, sum(counts), 0, text, chars, counts
            tree = TokenTree.of_leaves(text or "", chars, counts, counter)
            for e in log:
                tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
            numbers = len(chars), sum(counts), len(log), tree.n_tokens, tree.encoded
            if not keep:
                return numbers
            leaves = [len(x) for b in tree.blocks for x in b], [n for b in tree.counts for n in b]
            return *numbers, tree.text, *leaves

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, logs = batch.column("text").to_pylist(), batch.column(edits).to_pylist()
            got = [one(*x) for x in zip(texts, _lists(batch.column("leaf_chars")), _lists(batch.column("leaf_tokens")), logs)]
            types = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate(types[: len(COUNTS) + len(kept)])]
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *cols], names=[*keys, *COUNTS, *kept])

        return run

    schema = [*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} bigint" for c in COUNTS)]
    schema += ["text string, leaf_chars array<int>, leaf_tokens array<int>"] * keep
    return map_batches(trees, make, ", ".join(schema))


def count_edited(documents: DataFrame, edits: str = "edits", vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts before and after edits of documents without leaves: segmented first, then edited."""
    return apply_edits(segment(documents, vocabulary), edits, vocabulary, keep=False)
