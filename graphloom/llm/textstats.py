"""Counts over one text, shared by the rule ledger and the quality classifier."""

from __future__ import annotations

import numpy as np

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def word_ids(text: str) -> np.ndarray:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as numbers, equal words alike."""
    seen: dict[bytes, int] = {}
    words = text.encode("utf-8", "surrogatepass").split()  # splits bytes at exactly those six blanks
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more in the text."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    base = np.uint64(int(ids.max()) + 1)
    code = ids[:n]
    for k in range(1, window):
        if int(code.max()) > (2**64 - 1) // int(base) - 1:  # keep the codes exact
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
        code = code * base + ids[k : k + n]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def lines_of(text: str) -> tuple[int, int, int]:
    """Lines with a word, those equal to an earlier line, and the characters of the longest."""
    seen: set[str] = set()
    n = 0
    longest = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            n += 1
            seen.add(line)
            longest = max(longest, len(line))
    return n, n - len(seen), longest


def measure(text: str | None) -> dict[str, float]:
    """All counts of one text; a null text counts as an empty one."""
    text = text or ""
    ids = word_ids(text)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n_lines, n_dup_lines, longest_line = lines_of(text)
    per_word = np.bincount(ids.astype(np.int64)) if len(ids) else np.zeros(1, np.int64)
    return {
        "n_words": len(ids),
        "word_chars": len(text) - sum(map(text.count, BLANKS)),
        "n_symbols": int(sum(raw[ord(c)] for c in SYMBOLS)),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": repeated_words(ids),
        "n_lines": n_lines,
        "n_upper": int(raw[65:91].sum()),
        "n_lower": int(raw[97:123].sum()),
        "n_digits": int(raw[48:58].sum()),
        "n_marks": int(raw[ord("!")] + raw[ord("?")]),
        "n_stops": int(raw[ord(".")] + raw[ord(",")]),
        "n_bars": int(raw[ord("|")]),
        "n_high": int(raw[128:].sum()),
        "n_bytes": int(raw.sum()),
        "longest_line": longest_line,
        "n_distinct": int((per_word > 0).sum()),
        "n_once": int((per_word == 1).sum()),
        "top_word": int(per_word.max()),
        "n_stutter": int((ids[1:] == ids[:-1]).sum()),
        "word_entropy": _entropy(per_word),
    }


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log(p)).sum())
