"""Set-similarity joins against all pairs, with equal sets, hot items cut into blocks, nulls and repeated rows."""

import random
from itertools import combinations

import pytest

from graphloom.operators import setjoin


def sets_of(rows):
    out = {}
    for g, i in rows:
        if g is not None and i is not None:
            out.setdefault(g, set()).add(i)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    base = [[r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 12))] for _ in range(40)]
    out = []
    for g in range(160):
        own = list(r.choice(base))
        if r.random() < 0.5:
            own[r.randrange(len(own))] = r.choice("abcdefghijklmnop")
        out += [(g, i) for i in own]
    out += [(200 + g, i) for g in range(60) for i in "abc"]  # many groups with one set
    return [*out, *out[:20], (None, "a"), (3, None), (None, None)]


@pytest.mark.parametrize("block", [3, 2048])
@pytest.mark.parametrize("threshold, least", [(0.5, 1), (0.6, 5), (0.8, 2), (0.85, 5), (1.0, 1), (0.01, 3)])
def test_jaccard_pairs(spark, rows, monkeypatch, block, threshold, least):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    sets = {g: s for g, s in sets_of(rows).items() if len(s) >= least}
    want = {
        (a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        for a, b in combinations(sorted(sets), 2)
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold
    }
    got = setjoin.jaccard_pairs(spark.createDataFrame(rows, "g int, i string"), "g", "i", threshold, least).collect()
    assert len(got) == len(want)
    assert {(r.a, r.b): pytest.approx(r.jaccard) for r in got} == want


@pytest.mark.parametrize("block", [3, 2048])
def test_pairs_within(spark, rows, monkeypatch, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    count = {}
    for s in sets_of(rows).values():
        for p in combinations(sorted(s), 2):
            count[p] = count.get(p, 0) + 1
    got = setjoin.pairs_within(spark.createDataFrame(rows, "g int, i string"), "g", "i", 2).collect()
    assert {(r.a, r.b): r.n for r in got} == {p: n for p, n in count.items() if n >= 2}


def test_classes_and_links(spark):
    """A thousand equal groups are one class: its links are between classes, not between groups."""
    rows = [(g, i) for g in range(1000) for i in "abcdefghij"] + [(5000, i) for i in "abcdefghik"] + [(6000, "z")]
    members, links = setjoin.similar_sets(spark.createDataFrame(rows, "g int, i string"), "g", "i", 0.8)
    assert [(r.a, r.b, round(r.jaccard, 6)) for r in links.collect()] == [(0, 5000, round(9 / 11, 6))]
    assert {r["class"] for r in members.collect()} == {0, 5000, 6000}


def test_no_rows(spark):
    df = spark.createDataFrame([(None, "a")], "g int, i string")
    assert setjoin.jaccard_pairs(df, "g", "i", 0.8).collect() == [] == setjoin.pairs_within(df, "g", "i").collect()
    with pytest.raises(ValueError, match="threshold"):
        setjoin.jaccard_pairs(df, "g", "i", 0)
