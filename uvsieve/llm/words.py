"""Words of many texts at once, as byte spans and 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import mix64

#: ASCII white space: all other bytes belong to words.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Letters, digits and bytes beyond ASCII belong to words; ASCII punctuation parts them too.
PUNCTUATED = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(FACTOR), -1, 2**64))
PIECE = 1 << 20
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """FACTOR and its inverse to the powers 0 to n-1 (kept for the next call)."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((FACTOR, INVERSE)):
                _POWERS[k] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 20) - 1, base, np.uint64)], dtype=np.uint64)
    return _POWERS


def spans(data: np.ndarray, ends: np.ndarray, parts: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and stops, and the number of its text. No word crosses a text's end."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~parts[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = ends[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(ends, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes. Works through ``PIECE`` bytes at a time."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(stops, low + PIECE, "right")))
        out[at:to] = _hash_piece(data[low : int(stops[to - 1])], starts[at:to] - low, stops[at:to] - low)
        at = to
    return out


def _hash_piece(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        return mix64((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))


def shingles(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of ``size`` words of one text, and its text. A text with fewer words is one run."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    count = np.diff(np.r_[first, n])
    rank = np.arange(n) - np.repeat(first, count)
    total = np.repeat(count, count)
    keep = (rank + size <= total) | ((total < size) & (rank == 0))
    at = np.flatnonzero(keep)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            there = rank[at] + k < total[at]
            word = np.where(there, words[np.minimum(at + k, n - 1)], np.uint64(0))
            out = out * np.uint64(0xD1342543DE82EF95) + word + np.uint64(1)
    return mix64(out), owner[at]
