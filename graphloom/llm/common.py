"""What the operators of this subpackage share: reading, arrow maps, checkpoints on shared storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.scratch import materialize

__all__ = [
    "DOCUMENT_COLUMNS", "WordHash", "ascii_lower", "byte_words", "map_batches", "materialize", "new_columns", "runs",
    "table", "words",
]

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of a slice that a Python function is given at once; a single row may be larger.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def new_columns(columns: list[str], added: list[str]) -> None:
    """Refuse input columns that have the name of one that is added (in any case, as Spark compares names)."""
    taken = sorted({c.lower() for c in columns} & {c.lower() for c in added})
    if taken:
        raise ValueError(f"columns of these names are added, rename the input's: {', '.join(taken)}")


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the strings and binaries in each row."""
    total = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
            total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    return total


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow in slices of bounded rows and bytes. `make` runs once a task and gives the function for a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            ends = np.cumsum(_sizes(batch))
            at = 0
            while at < batch.num_rows:
                room = SLICE_BYTES + (ends[at - 1] if at else 0)
                step = min(SLICE_ROWS, max(1, int(np.searchsorted(ends, room, side="right")) - at))
                yield f(batch.slice(at, step))
                at += step

    return df.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of an integer column, from batches in which equal values are neighbours."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and values[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def ascii_lower(c):
    """Lower-case A-Z alone. Spark's lower() knows more letters, so it serves where all are ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, upper, upper.lower())
    )


def words(c):
    """Array of the words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; null text has none."""
    parts = F.split(ascii_lower(c), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


#: Bytes of a word keep their value (A-Z lower-cased), all others become a blank.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def byte_words(text: str | None) -> list[bytes]:
    """The same words as words(), as UTF-8 bytes, in Python."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


WORD_CACHE = 1 << 20


class WordHash(dict):
    """64-bit hashes of words, remembered; cleared when it has grown to WORD_CACHE entries."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h
