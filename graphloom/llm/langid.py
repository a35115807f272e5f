"""Language identification with a string kernel.

The kernel is a blended spectrum: two texts are as alike as the byte 1-, 2- and 3-grams that both contain
(presence, not counts), divided by the geometric mean of how many each contains. Landmark documents give a
Nyström feature map of that kernel, one-versus-rest kernel ridge regression gives a weight vector for each
language, and both are linear in a text's presence vector, so a batch is scored by two matrix products.

Texts are lower-cased by ASCII rules and bytes other than letters and non-ASCII bytes count as one blank, so
the alphabet is bounded. The model is fitted on at most `max_rows` documents with a language, an equal share of
each, chosen by a hash of their id, and at most `max_chars` characters (see `train`); every document is scored over
its whole text.

A text that is null or has no letter gets `und` with score 0. Without a single document to learn from, all do. Of equal
margins the language that comes first by name is taken; repeated rows are learned from as often as they are taken and
are predicted alike; an empty table gives an empty one. Other columns keep their values, but none may have the name of
one that is added.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches, new_columns
from graphloom.llm.quality import fold

#: A letter, in Python as in Spark; numbers such as a half or a Roman eight are none.
LETTERS = r"\p{L}"
LETTER = regex.compile(LETTERS)
FOLDS, HELD_OUT = 4, 2
#: Symbols: blank, a-z, and the 128 bytes that are not ASCII.
SIZE = 1 + 26 + 128
SYMBOL = np.zeros(256, np.int32)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:] = np.arange(27, SIZE)


def grams(text: str) -> list[np.ndarray]:
    """Codes of a text's 1-, 2- and 3-grams, with repeats; runs of blanks are one blank."""
    s = SYMBOL[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)]
    s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
    two = s[:-1] * SIZE + s[1:]
    return [s, SIZE + two, SIZE + SIZE**2 + two[:-1] * SIZE + s[2:]]


N_CODES = SIZE + SIZE**2 + SIZE**3
#: Numbers of a presence matrix that are held at once.
DENSE = 1 << 24


@dataclass
class Model:
    column: np.ndarray  # of each code: its column, or `width` if the training texts never had it
    width: int
    landmarks: np.ndarray  # (width, m) presence of each gram in each landmark, divided by the root of its count
    weights: np.ndarray  # (m, languages): the Nyström map and the ridge weights in one
    bias: np.ndarray
    languages: list[str]

    def presence(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), self.width + 1), np.float32)
        for i, t in enumerate(texts):
            for codes in grams(t):
                x[i, self.column[codes]] = 1
        x = x[:, :-1]
        return x / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))

    def margins(self, texts: list[str]) -> np.ndarray:
        """Batched products, of as many texts at a time as DENSE numbers hold."""
        n = max(1, DENSE // (self.width + 1))
        parts = [(self.presence(texts[a : a + n]) @ self.landmarks) @ self.weights for a in range(0, len(texts), n)]
        return np.concatenate(parts) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (share of the winner's margin in a softmax) of each text."""
        has = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if has and self.languages:
            m = self.margins([texts[i] for i in has]).astype(np.float64)
            e = np.exp(4 * (m - m.max(axis=1, keepdims=True)))
            best = m.argmax(axis=1)
            share = e[np.arange(len(has)), best] / e.sum(axis=1)
            for i, b, s in zip(has, best, share):
                names[i], scores[i] = self.languages[b], float(min(1.0, s))
        return names, scores


def fit(texts: list[str], langs: list[str], landmarks: int = 160, ridge: float = 1e-3) -> Model:
    """Landmarks are the first texts of each language in turn; the caller has shuffled them by hash."""
    languages = sorted(set(langs))
    present = np.zeros(N_CODES, bool)
    for t in texts:
        for codes in grams(t):
            present[codes] = True
    width = int(present.sum())
    column = np.full(N_CODES, width, np.int32)
    column[present] = np.arange(width, dtype=np.int32)
    model = Model(column, width, np.zeros((width, 0), np.float32), np.zeros((0, 0)), np.zeros(0), languages)
    if not languages:
        return model
    by = {name: [i for i, x in enumerate(langs) if x == name] for name in languages}
    order = [by[n][k] for k in range(max(map(len, by.values()))) for n in languages if k < len(by[n])]
    model.landmarks = np.ascontiguousarray(model.presence([texts[i] for i in order[:landmarks]]).T)
    step = max(1, DENSE // (width + 1))
    kernel = np.concatenate(
        [model.presence(texts[a : a + step]) @ model.landmarks for a in range(0, len(texts), step)]
    ).astype(np.float64)
    own = kernel[np.array(order[:landmarks])]
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # the Nyström map: kernel @ root
    phi = kernel @ root
    mean = phi.mean(axis=0)
    target = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = len(langs) / (len(languages) * np.array([len(by[x]) for x in langs]))  # languages count alike
    centred, goal = phi - mean, target - (t0 := np.average(target, axis=0, weights=weight))
    a = centred.T @ (centred * weight[:, None]) + ridge * len(langs) * np.eye(phi.shape[1])
    w = np.linalg.solve(a, centred.T @ (goal * weight[:, None]))
    model.weights = (root @ w).astype(np.float32)
    model.bias = (t0 - mean @ w).astype(np.float32)
    return model


def train(documents: DataFrame, max_rows: int = 4_000, max_chars: int = 20_000_000) -> Model:
    """Fit on documents outside the held-out fold: at most max_rows, an equal share a language, whole texts.

    max_chars bounds the driver's memory; languages have equal shares of it too. Documents are taken in the order of
    their id's hash, those too long for the share last. Where the taken texts exceed the share, the longest are left
    out. A language always keeps its shortest taken text, whole, so one with long texts alone may exceed its share by it.
    """
    known = documents.where(
        F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("text").rlike(LETTERS)
    )
    n_langs = max(1, known.agg(F.count_distinct("lang")).first()[0])
    share, chars = max(1, max_rows // n_langs), max(1, max_chars // n_langs)
    h = F.xxhash64("doc_id")
    ids = known.select("doc_id", "lang", F.char_length("text").alias("n"), h.alias("h"))
    order = [F.col("n") > chars, F.col("h"), F.col("doc_id")]
    # a language's share by hash: rows beyond about twice the share in that order can't be in it and aren't sent
    sizes = ids.groupBy("lang").agg(F.sum((F.col("n") <= chars).cast("long")).alias("fit"), F.count("*").alias("all"))
    low = F.col("h").cast("double") / 2.0**64 + 0.5  # the hash's place among all hashes, 0 to 1
    room = F.lit(2.0 * share + 200)
    fits = F.when(F.col("n") <= chars, low * F.col("fit") <= room).otherwise(
        (F.col("fit") < share) & (low * (F.col("all") - F.col("fit")) <= room)
    )
    near = ids.join(F.broadcast(sizes), "lang").where(fits).drop("fit", "all")  # one row a language
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    by_length = Window.partitionBy("lang").orderBy("n", "h", "doc_id")
    chosen = ranked.where(F.col("r") <= share).select(
        "*", F.sum("n").over(by_length).alias("sum_n"), F.row_number().over(by_length).alias("place")
    )
    chosen = chosen.where((F.col("sum_n") <= chars) | (F.col("place") == 1)).select("doc_id", "lang", "h")
    texts = documents.select("doc_id", "text", F.col("lang").alias("l"))
    rows = texts.join(F.broadcast(chosen), "doc_id").where("l = lang").orderBy("h", "doc_id").limit(max_rows)
    rows = rows.select("text", "lang").toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("lang").to_pylist())


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """The documents' columns but the text, with lang_pred and score; rows are returned one for one."""
    keys = [c for c in documents.columns if c != "text"]
    new_columns(keys, ["lang_pred", "score"])
    kinds = dict(documents.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "lang_pred string", "score double"])
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded: max_rows texts, N_CODES codes

    def make():
        own = shared.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = own.predict(batch.column("text").to_pylist())
            cols = [*(batch.column(k) for k in keys), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            return pa.RecordBatch.from_arrays(cols, names=[*keys, "lang_pred", "score"])

        return run

    return map_batches(documents.select(*keys, "text"), make, schema)
