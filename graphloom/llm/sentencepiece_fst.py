"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into machines, arrays of weighted arcs: the normaliser (blanks to U+2581 and a blank in
front), the pieces (a trie that writes a piece where one ends) and byte fallback (characters without a piece to the
pieces of their bytes). They are composed with each input as it is read, and the shortest path in the tropical
semiring (min, +), found best first, gives the pieces.

In a unigram model a piece weighs the negative logarithm of its probability. A byte-pair model doesn't take the path with
the best scores: it merges pairs by rank. Its pieces weigh 0 and a fourth machine, an acceptor of neighbours, is
composed with them: an arc from one piece to the next weighs 0 if merging their joint text gives back just these two, and
infinity otherwise. Exactly one path of finite weight is left, the model's own encoding.

No piece crosses the front of a run of blanks, so a text is composed a segment (blanks and what follows them) at a
time, in any length, and the paths of short segments are remembered. Of paths of equal weight any one may be taken. Null and empty texts have no pieces, repeated rows are encoded alike, an empty table
gives an empty one. Decoding an encoding gives the text back, U+2581 as a blank.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from functools import lru_cache, partial
from heapq import heappop, heappush
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import map_batches, new_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Kinds of pieces and of models in a model file, and what an unknown character weighs beyond the worst piece
#: (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, PAIRS = 1, 2
UNKNOWN_PENALTY = 10.0
#: Inputs of arcs: code points, bytes or the normaliser's two classes; EPSILON reads or writes nothing.
EPSILON, OTHER, A_BLANK = -1, 0, 1
RUNS = re.compile("[ ]+|[^ ]+").findall
#: The acceptor's state where no piece stands before.
FRESH = -1
#: Entries that the memory of segments and that of neighbours may hold before they are cleared.
CACHE = 1 << 19


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes):
    """The (number, value) fields of a protocol-buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            if kind == 2:
                size, i = _varint(b, i)
            else:
                size = 4 if kind == 5 else 8
            value, i = b[i : i + size], i + size
        yield key >> 3, value


class Machine:
    """A transducer whose arcs are arrays: arc k leads from source[k] to target[k], reads input[k] (EPSILON: nothing),
    writes output[k] and weighs weight[k]. A state has one arc for an input at most; state 0 is the start."""

    def __init__(self, arcs: list[tuple[int, int, int, float, int]]):
        columns = list(zip(*arcs)) or [()] * 5
        self.source, self.input, self.output, self.target = (array("i", columns[k]) for k in (0, 1, 2, 4))
        self.weight = array("d", columns[3])
        #: Of a state: its arcs by what they read.
        self.leave: list[dict[int, int]] = [{} for _ in range(max([0, *self.source, *self.target]) + 1)]
        for k, (state, read) in enumerate(zip(self.source, self.input)):
            self.leave[state][read] = k


def normaliser(prefix: bool, squeeze: bool) -> Machine:
    """Blanks to U+2581, one in front of the text, and runs of blanks as one if they are squeezed (and none at the ends).

    U+2581 in a text is a character like others: squeezing leaves it alone.

    Inputs are OTHER or A_BLANK; an output of 2 * n + c writes n times U+2581, then the input itself if c is 1.
    """
    first, inside, waiting = 0, 1, 2
    if squeeze:
        return Machine([
            (first, A_BLANK, 0, 0.0, first), (first, OTHER, 2 * prefix + 1, 0.0, inside),
            (inside, A_BLANK, 0, 0.0, waiting), (inside, OTHER, 1, 0.0, inside),
            (waiting, A_BLANK, 0, 0.0, waiting), (waiting, OTHER, 3, 0.0, inside),
        ])
    return Machine([
        (first, A_BLANK, 2 * prefix + 2, 0.0, inside), (first, OTHER, 2 * prefix + 1, 0.0, inside),
        (inside, A_BLANK, 2, 0.0, inside), (inside, OTHER, 1, 0.0, inside),
    ])


def piece_machine(ids: dict[str, int], weight: dict[str, float]) -> Machine:
    """A trie that reads the characters of each piece; the arc back to the start reads nothing and writes the piece."""
    arcs: list[tuple[int, int, int, float, int]] = []
    states: dict[str, int] = {"": 0}
    for piece, at in ids.items():
        for n in range(1, len(piece) + 1):
            if piece[:n] not in states:
                states[piece[:n]] = len(states)
                arcs.append((states[piece[: n - 1]], ord(piece[n - 1]), EPSILON, 0.0, states[piece[:n]]))
        arcs.append((states[piece], EPSILON, at, weight[piece], 0))
    return Machine(arcs)


def _steps(machine: Machine) -> dict:
    """The piece machine by what it reads: of a character (next arcs, piece that may end there or EPSILON, its weight)."""
    nodes: list[dict] = [{} for _ in machine.leave]
    for k, (at, read, to) in enumerate(zip(machine.source, machine.input, machine.target)):
        if read != EPSILON:
            end = machine.leave[to].get(EPSILON)
            writes = (EPSILON, 0.0) if end is None else (machine.output[end], machine.weight[end])
            nodes[at][chr(read)] = (nodes[to], *writes)
    return nodes[0]


def byte_machine(pieces: dict[int, int], unknown: int) -> Machine:
    """Reads the UTF-8 bytes of a character without a piece and writes their pieces; without such pieces, one unknown."""
    if pieces:
        return Machine([(0, b, at, 0.0, 0) for b, at in pieces.items()])
    head = [(0, b, unknown, 0.0, 0) for b in range(256) if b & 192 != 128]
    return Machine(head + [(0, b, EPSILON, 0.0, 0) for b in range(128, 192)])


class Neighbours:
    """Acceptor of sequences of a byte-pair model's pieces. Its states are pieces (FRESH: no piece before), and the arc
    that reads piece b in state a weighs 0 if the model, merging the joint text of a and b, leaves just these two,
    and infinity otherwise. Arcs are made when they are first asked for, from the order of the merges."""

    def __init__(self, pieces: list[str], rank: dict[str, float]):
        self.pieces, self.rank = pieces, rank
        self.weight: dict[int, float] = {}

    def merged(self, text: str) -> list[str]:
        """What merging leaves: the best-scored neighbours go first, the left of equals."""
        parts, rank = list(text), self.rank
        scores = [rank.get(a + b, -inf) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > -inf:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            for k in range(max(0, at - 1), min(at + 1, len(scores))):
                scores[k] = rank.get(parts[k] + parts[k + 1], -inf)
        return parts

    def arc(self, state: int, piece: int) -> float:
        key = state * len(self.pieces) + piece
        known = self.weight.get(key)
        if known is None:
            if len(self.weight) >= CACHE:
                self.weight.clear()
            alone = [self.pieces[piece]] if state == FRESH else [self.pieces[state], self.pieces[piece]]
            known = self.weight[key] = 0.0 if self.merged("".join(alone)) == alone else inf
        return known


class Transducer:
    """The machines of one model; `encode` and `decode` are what the model's own library gives."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}  # of a byte: its piece
        self.byte_of: dict[int, int] = {}
        self.silent: set[int] = set()
        self.unknown = 0
        kind_of_model, self.prefix, squeeze, escape = 1, True, True, True
        for number, value in _fields(model):
            if number == 1:
                self._piece(dict(_fields(value)))
            elif number == 2:
                kind_of_model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("only models whose normaliser maps no characters are supported")
                self.prefix, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                escape = bool(spec.get(5, 1))
        if kind_of_model not in (UNIGRAM, PAIRS) or not escape:
            raise ValueError("only unigram and byte-pair models that escape blanks are supported")
        pairs = kind_of_model == PAIRS
        if not pairs and max(self.rank.values(), default=0.0) > 0:
            raise ValueError("scores of a unigram model must be logarithms of probabilities")
        #: Scores are logarithms of probabilities in a unigram model, ranks of merges in a byte-pair model.
        weights = {p: 0.0 if pairs else -r for p, r in self.rank.items()}
        self.normaliser = normaliser(self.prefix, squeeze)
        self.runs: dict[tuple[int, int, int], tuple[str, bool, int]] = {}
        self.machine = piece_machine(self.ids, weights)
        self.reads, self.longest = _steps(self.machine), max(map(len, self.ids), default=0)
        self.fallback = byte_machine(self.bytes, self.unknown)
        self.fallback_weight = 0.0 if pairs else max(weights.values(), default=0.0) + UNKNOWN_PENALTY
        self.neighbours = Neighbours(self.pieces, self.rank) if pairs else None
        self.characters = {p for p in self.ids if len(p) == 1}
        apart = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        #: No piece has a blank behind another character, so every path has a boundary there and a text can be cut.
        self.cut = re.compile(f"[ {BLANK}]*[^ {BLANK}]+|[ {BLANK}]+" if apart else "(?s).+").findall
        #: Paths of segments that were met, by the normaliser's state in front: pieces, and the state behind.
        self.segments: list[dict[str, tuple[tuple[int, ...], int]]] = [{}, {}, {}]
        self.raw = [p.replace(BLANK, " ").encode() for p in self.pieces]  # what each piece is decoded to
        self.raw[self.unknown] = " ⁇ ".encode()
        for at in self.silent:
            self.raw[at] = b""
        for at, b in self.byte_of.items():
            self.raw[at] = bytes([b])

    def _piece(self, f: dict[int, object]) -> None:
        at, kind = len(self.pieces), f.get(3, NORMAL)
        text = bytes(f.get(1, b"")).decode()
        self.pieces.append(text)
        if kind == NORMAL:
            self.ids[text] = at
            self.rank[text] = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
        elif kind == BYTE:
            self.bytes[int(text[3:-1], 16)] = at
            self.byte_of[at] = int(text[3:-1], 16)
        elif kind == UNKNOWN:
            self.unknown = at
        elif kind == CONTROL:
            self.silent.add(at)
        else:
            raise ValueError("models with user-defined or unused pieces are not supported")

    def normalise(self, text: str, state: int = 0) -> tuple[str, int]:
        """What the normaliser writes for a text read from a state on, and the state it is left in."""
        out: list[str] = []
        for run in RUNS(text):
            read = A_BLANK if run[0] == " " else OTHER
            key = state, read, len(run) if read == A_BLANK else min(len(run), 2)
            known = self.runs.get(key)
            if known is None:
                known = self._run(*key)
                if key[2] <= 64:
                    self.runs[key] = known
            front, copies, state = known
            out.append(front + run if copies else front)
        return "".join(out), state

    def _run(self, state: int, read: int, n: int) -> tuple[str, bool, int]:
        """The normaliser over a run of one class: what it writes in front, whether it copies the run, its state."""
        front, copies = "", False
        for _ in range(n):
            arc = self.normaliser.leave[state][read]
            front += BLANK * (self.normaliser.output[arc] >> 1)
            copies = bool(self.normaliser.output[arc] & 1)
            state = self.normaliser.target[arc]
        return front, copies, state

    def in_bytes(self, c: str) -> tuple[int, ...]:
        """What the fallback machine writes for a character."""
        b = self.fallback
        read = (b.leave[0][x] for x in c.encode("utf-8", "surrogatepass"))
        return tuple(b.output[k] for k in read if b.output[k] != EPSILON)

    def shortest_path(self, text: str) -> tuple[int, ...]:
        """Pieces of the path of least weight through a normalised text.

        Nodes are places, with the acceptor's state there: one a place is enough, as a unigram model's acceptor has
        one state and a prefix has one encoding in a byte-pair model. The node with the least sum is settled first and
        relaxes its arcs; an arc meets the acceptor when its turn comes.
        """
        n = len(text)
        back, state = [0] + [-1] * n, [FRESH] * (n + 1)
        accept = self.neighbours
        known, width = (accept.weight.get, len(self.pieces)) if accept else (None, 0)
        heap: list[tuple[float, int, int, int]] = []
        # weights that are 0 or infinite need no order: the arc found last, the longest of its node, goes first
        push, take = (heap.append, heap.pop) if accept else (partial(heappush, heap), partial(heappop, heap))
        reads, longest = self.reads, self.longest
        at, so_far, whole = 0, 0.0, self.characters.issuperset(text)
        while at < n:
            arcs, end = reads, at
            for c in text[at : at + longest]:
                step = arcs.get(c)
                if step is None:
                    break
                end += 1
                arcs, piece, weight = step
                if piece != EPSILON and back[end] < 0:
                    push((so_far + weight, -end, at, piece))
            if not whole and text[at] not in self.characters:
                # nothing merges across a character without a piece
                push((so_far + self.fallback_weight, -at - 1, at, FRESH))
            while True:
                so_far, end, origin, piece = take()
                if back[-end] >= 0:
                    continue
                if known and piece != FRESH:
                    more = known(state[origin] * width + piece)
                    if more is None:
                        more = accept.arc(state[origin], piece)
                    if more:
                        continue
                break
            at = -end
            back[at], state[at] = origin, piece
        path: list[int] = []
        while n:
            path.extend((state[n],) if state[n] != FRESH else reversed(self.in_bytes(text[back[n]])))
            n = back[n]
        return tuple(reversed(path))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        state, memory = 0, self.segments
        for segment in self.cut(text or ""):
            known = memory[state].get(segment)
            if known is None:
                normal, to = self.normalise(segment, state)
                known = self.shortest_path(normal), to
                if len(segment) <= 64:
                    if len(memory[state]) >= CACHE:
                        memory[state].clear()
                    memory[state][segment] = known
            path, state = known
            out += path
        if not self.bytes and self.unknown in out:  # unknown characters side by side are one piece
            out = [p for k, p in enumerate(out) if p != self.unknown or k == 0 or out[k - 1] != p]
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    """A model's machines, compiled once in a Python worker."""
    return Transducer(model)


def encode_documents(documents: DataFrame, model: str = MODEL, ids: bool = True) -> DataFrame:
    """The documents' columns but the text with n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers),
    round_trip (decoding gives the text back) and, if asked for, token_ids array<int>.

    The model is read once, on the driver, and its bytes are sent to the tasks. Rows are returned one for one.
    """
    keys = [c for c in documents.columns if c != "text"]
    kinds = dict(documents.dtypes)
    names = [*keys, "n_tokens", "ids_sha256", "round_trip", *["token_ids"] * ids]
    new_columns(keys, names[len(keys) :])
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n_tokens bigint, ids_sha256 string, round_trip boolean"])
    with open(model, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def make():
        machine = compiled(shared.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            got = [machine.encode(t) for t in texts]
            cols = [
                pa.array([len(g) for g in got], pa.int64()),
                pa.array([hashlib.sha256(np.array(g, "<i4").tobytes()).hexdigest() for g in got], pa.string()),
                pa.array([machine.decode(g) == (t or "").replace(BLANK, " ") for g, t in zip(got, texts)], pa.bool_()),
            ]
            if ids:
                cols.append(pa.array(got, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *cols], names=names)

        return run

    return map_batches(documents.select(*keys, "text"), make, schema + (", token_ids array<int>" if ids else ""))
