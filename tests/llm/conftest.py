"""Small documents with every awkward case: nulls, empties, repeats, ties, long texts, clashing columns."""

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, w string, n int, size int, h bigint"


def words(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    base = words(1, 60)
    edited = base.split()
    edited[30] = "changed"
    texts = [
        base,
        base,  # copy
        " ".join(edited),  # near copy
        None,
        "",
        "   \n\n ",
        "!!! ???",
        words(2, 3),
        words(2, 3),
        words(3, 30) + "\n" + words(4, 12) + "\n" + words(4, 12),
        words(5, 20) + "\n" + words(4, 12),
        words(6, 5000),
        "mail me at a.b+c@ex-ample.co.uk or +1 (852) 555-5043; card 4539 1488 0343 6467, ip 10.0.0.255 and 1.2.3.999",
        "Ünïcödé ÀÉ straße 日本語 ▁ tokens\t\x0b mixed\r\nlines 😀",
        words(7, 12).upper() + " ### $$$",
        base,
    ]
    out = [(i, t, ["en", "fr", None][i % 3], "s0", len(t or ""), "x", 1, 2, 3) for i, t in enumerate(texts)]
    out[-1] = (None, *out[-1][1:])  # null id
    out.append(out[9])  # a repeated row
    return out


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
