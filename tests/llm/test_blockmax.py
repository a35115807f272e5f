"""Block-max search against scores of every document, on awkward rows and small blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import blockmax

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [x.translate(LOWER) for x in TERM.findall(text or "")]


def plain(documents, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in documents]
    n_docs, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    texts = {}
    for i, t in items:
        if i is not None and terms(t):
            texts.setdefault(i, set()).add(tuple(terms(t)))
    out = []
    for item, each in texts.items():
        asked = Counter(w for t in each for w in t)
        scored = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // max(1, total)
            s = sum(
                r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t, r in asked.items()
            )
            if s > 0:
                scored.append((-s, i is None, i or 0))
        for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if null else i, -s))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    common = [f"w{i}" for i in range(30)]
    rare = [f"x{i}é" for i in range(400)]
    body = [" ".join(r.choices(common, k=r.randint(1, 60)) + r.choices(rare, k=r.randint(0, 12))) for _ in range(250)]
    return body + [body[3]] * 40 + [" ".join(common * 300)]  # forty copies, one long text


@pytest.mark.parametrize("entries, query_words", [(1 << 16, 1 << 18), (60, 40)])
def test_search(spark, rows, texts, monkeypatch, entries, query_words):
    monkeypatch.setattr(blockmax, "QUERY_WORDS", query_words)
    monkeypatch.setattr(blockmax, "BLOCK_DOCUMENTS", 7)
    monkeypatch.setattr(blockmax, "BLOCK_ENTRIES", entries)
    documents = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(texts)]
    items = [(1, texts[3]), (2, "W1 w1 W1 x5É x5é"), (3, None), (4, "?! --"), (None, "w1"), (5, "nowhere-to be found"), (6, "w7")]
    items += [(6, "w7"), (6, "x9é w8"), (7, "日本語 straße"), (8, texts[-1])]
    made = spark.createDataFrame([(*x, "n", 1) for x in documents], "doc_id bigint, text string, block string, q int").repartition(3)
    found = blockmax.rank(made, spark.createDataFrame([(*x, 1) for x in items], "item_id int, text string, rank int"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(found.collect()) == ordered(plain(documents, items))


def test_no_rows(spark, documents, empty):
    items = spark.createDataFrame([(1, "abc")], "item_id bigint, text string")
    assert blockmax.rank(empty, items).collect() == []
    assert blockmax.rank(documents, items.limit(0)).collect() == []
    assert blockmax.rank(documents.where("text IS NULL"), items).collect() == []


def test_blocks_are_pruned(spark, texts, monkeypatch):
    """Of the blocks with a term of the query, only those whose bound reaches the threshold are opened."""
    monkeypatch.setattr(blockmax, "BLOCK_DOCUMENTS", 4)
    index = blockmax.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1))
    queries = blockmax.Queries.of([(0, terms("x1é x2é x2é w1"))])
    queries.weights = np.where(queries.terms == queries.terms[queries.term[-1]], 100, 3000)  # w1 is in most documents
    held = index.rows.toArrow()
    opened = []
    real = blockmax.Block
    monkeypatch.setattr(blockmax, "Block", lambda batch, row, q: opened.append(row) or real(batch, row, q))
    (out,) = blockmax._pruned(queries, 3, np.array([1]))(held.to_batches())
    everything = []
    for batch in held.to_batches():
        for row in range(batch.num_rows):
            b = real(batch, row, queries)
            everything += [(-int(s), i) for s, i in zip(b.scores(queries, 0), b.ids) if s > 0]
    assert [(r["doc_id"], r["score"]) for r in out.to_pylist()] == [(i, -s) for s, i in sorted(everything)[:3]]
    assert 0 < len(opened) < held.num_rows / 3 < len(everything) / 4
