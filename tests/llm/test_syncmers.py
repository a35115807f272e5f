"""Closed syncmers against a plain version, with the hash that Spark has, and on awkward rows."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import syncmers

UNSPACED = "฀-໿က-႟ក-៿⺀-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
UNIT = re.compile(f"[{UNSPACED}]|[^\x00-\x2f\x3a-\x60\x7b-\x7f{UNSPACED}]+")
LOWER = {c: c + 32 for c in range(65, 91)}
WORD = 2**64 - 1


def spark_hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), h)
    return h


def signed(x):
    return x - 2**64 if x >> 63 else x


def plain(text, k=5, s=2):
    if not text:
        return []
    units = [spark_hash(u) for u in UNIT.findall(text.translate(LOWER))]
    out, last = [], None
    runs = [signed(spark_hash(*units[i : i + s])) for i in range(len(units) - s + 1)]
    for i in range(len(units) - k + 1):
        inner = runs[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            parts = [runs[i + j] & WORD for j in range(0, k - s + 1, s)] + units[i + k // s * s : i + k]
            out.append((spark_hash(*parts) & 0xFFFFFFFF) << 4 | (0 if last is None else i - last))
            last = i
    if not out:
        out = [((spark_hash(*units) if units else spark_hash(text)) & 0xFFFFFFFF) << 4]
    return out


def dice(a, b):
    return 2 * len(set(a) & set(b)) / (len(set(a)) + len(set(b))) if a or b else 1.0


def plain_rows(rows):
    h = lambda t: signed(spark_hash(t))
    docs = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), h(x[1])))
    out = []
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, e, n = plain(t), plain(edited), plain(after)
        hexed = [",".join(f"{x:x}" for x in v) for v in (a, e)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *hexed, dice(a, e), dice(a, n)))
    return out


@pytest.mark.parametrize("k, s", [(5, 2), (6, 2), (4, 3), (3, 1), (7, 3)])
def test_anchors(spark, rows, k, s):
    texts = [r[1] for r in rows] + ["a b c d e", "a b c d", "ประเทศไทยสวยงามมาก 日本語の文章です", "x " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(syncmers.anchors(F.col("text"), k, s).alias("a")).collect()
    assert [r["a"] for r in got] == [plain(t, k, s) for t in texts]


@pytest.mark.parametrize("ranges", ["1", "4", "13"])
def test_fingerprints(spark, rows, ranges):
    r = random.Random(4)
    more = [(100 + r.randint(0, 400), " ".join(r.choices("abcdefgh", k=r.randint(0, 60))), *rows[0][2:]) for _ in range(120)]
    more += [(-(2**63), "least id of all and some words", *rows[0][2:]), (2**63 - 1, "the greatest one", *rows[0][2:])]
    every = rows + more + more[:5]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        df = spark.createDataFrame(every, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, r int, size int, h bigint")
        got = syncmers.fingerprints(df.repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_rows(every)))


def test_few_rows(spark, empty):
    assert syncmers.fingerprints(empty).collect() == []
    one = spark.createDataFrame([(None, "alone in a table of one row")], "doc_id bigint, text string")
    (r,) = syncmers.fingerprints(one).collect()
    assert r["near_next"] == 1.0 and r["n_chars"] == 27


def test_anchors_are_context_free(spark):
    """A text embedded in another keeps all its anchors but the first one's distance; every stretch has some."""
    r = random.Random(1)
    words = [f"w{r.randint(0, 500)}" for _ in range(400)]
    middle, around = words[100:300], " ".join(words[:50])
    texts = [" ".join(middle), f"{around} {' '.join(middle)} {around}"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    a, b = (x["a"] for x in df.select(syncmers.anchors(F.col("text")).alias("a")).collect())
    assert [x >> 4 for x in a] == [x >> 4 for x in b if x >> 4 in {y >> 4 for y in a}]
    assert set(a[1:]) <= set(b)
    assert all(0 < x & 15 <= syncmers.K - syncmers.S for x in b[1:])
    assert 0.35 < len(a) / len(middle) < 0.65
