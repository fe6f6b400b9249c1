"""Hashes of the words of many texts at once: prefix sums of a polynomial over the bytes, so no word is cut out in Python."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, to n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            step = np.full(max(n, 1 << 20), base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value's bits over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after another, and where each text's words begin (one more entry than texts). `lower`: A-Z as a-z."""
    coded = [(t or "").encode() for t in texts]
    if lower:
        coded = [c.lower() for c in coded]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    power, inverse = powers(len(data))
    edge = np.empty(len(data) + 1, bool)
    blank = BLANK[data]
    edge[0] = not blank[0]
    edge[1:-1] = blank[1:] != blank[:-1]
    edge[-1] = False
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    sizes = (ends - starts).astype(np.uint64)
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + sizes * np.uint64(0xD6E8FEB86659FD93))
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(c) + 1 for c in coded])])
    return words, np.searchsorted(starts, first)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, across texts too; the caller drops those that begin in one text and end in another."""
    h = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9FB21C651E98DF25) + words[k : k + len(h)]
    return mix(h + np.uint64(n))
