"""Pair merging for many words at once, with optional keyed dropout of candidate merges.

A candidate merge is a pair of neighbouring symbols that the vocabulary can join. Candidates are
taken best rank first, leftmost first among equals. With dropout, a candidate whose keyed hash
falls below the rate is skipped for good; the key is the word's own, and the candidate's identity
is where it begins, where its two symbols meet and where it ends. Because that decision depends
on nothing else, the order of processing and the machine do not matter.

Short words are merged side by side in numpy, one merge per word and round; a long word goes
through a heap (the agenda). Both make the same merges.
"""

from __future__ import annotations

import heapq

import numpy as np

from .common import mix64, ragged

#: Longer words (in symbols) go through the agenda.
LONG = 96
#: Cells of the symbol matrix that are worked on at a time.
CELLS = 400_000
NEVER = np.int32(2**31 - 1)


class PairTable:
    """Which pairs merge, at which rank, into which symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (np.asarray(left, np.int64) << 32 | np.asarray(right, np.int64)).view(np.uint64)
        self.shift = np.uint64(64 - max(1, len(keys).bit_length() + 1))
        order = np.argsort(self._bucket(keys), kind="stable")
        self.keys = keys[order]
        self.opening = np.searchsorted(self._bucket(self.keys), np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        self.rank, self.merged = np.asarray(rank, np.int32)[order], np.asarray(merged, np.int32)[order]

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)).view(np.uint64)
        bucket = self._bucket(keys)
        at, end = self.opening[bucket], self.opening[bucket + 1]
        rank, merged = np.full(len(keys), NEVER), np.full(len(keys), -1, np.int32)
        todo = np.flatnonzero(at < end)
        at, end, keys = at[todo], end[todo], keys[todo]
        while len(todo):
            same = self.keys[at] == keys
            hit = np.flatnonzero(same)
            rank[todo[hit]], merged[todo[hit]] = self.rank[at[hit]], self.merged[at[hit]]
            more = np.flatnonzero(~same & (at + 1 < end))
            todo, at, end, keys = todo[more], at[more] + 1, end[more], keys[more]
        return rank, merged


def place_hash(start, middle, end) -> np.ndarray:
    """A candidate's identity within its word."""
    with np.errstate(over="ignore"):
        place = np.asarray(start, np.uint64) * np.uint64(0x9E3779B1) + np.asarray(middle, np.uint64) * np.uint64(0x85EBCA6B3) + np.asarray(end, np.uint64) * np.uint64(0xC2B2AE3D27)
        return mix64(place)


def candidate_hash(key, start, middle, end) -> np.ndarray:
    """The keyed hash that decides on a candidate."""
    with np.errstate(over="ignore"):
        return mix64(np.asarray(key, np.uint64) ^ place_hash(start, middle, end))


def threshold(rate: float) -> np.uint64:
    return np.uint64(min(int(rate * 2.0**64), 2**64 - 1))


def _agenda(symbols: np.ndarray, table: PairTable, rate: float, key: int, taken: list | None = None) -> list[int]:
    ids, n = symbols.tolist(), len(symbols)
    after, before, end = [*range(1, n), -1], [*range(-1, n - 1)], [*range(1, n + 1)]
    below, heap = int(threshold(rate)), []
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def offer(pairs: list[tuple[int, int]]) -> None:
        left, right = [i for i, _ in pairs], [j for _, j in pairs]
        new = [(ids[i], ids[j]) for i, j in pairs]
        unknown = [p for p in set(new) if p not in known]
        if unknown:
            ranks, merged = table.find(np.array([a for a, _ in unknown]), np.array([b for _, b in unknown]))
            known.update(zip(unknown, zip(ranks.tolist(), merged.tolist(), strict=True), strict=True))
        skipped = candidate_hash(np.uint64(key), left, right, [end[j] for j in right]).tolist() if rate else [2**64] * len(pairs)
        for i, j, p, h in zip(left, right, new, skipped, strict=True):
            if known[p][0] != NEVER and (not rate or h >= below):
                heapq.heappush(heap, (known[p][0], i, j, end[j]))

    if n > 1:
        offer([(i, i + 1) for i in range(n - 1)])
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if ids[i] < 0 or ids[j] < 0 or after[i] != j or end[j] != e:
            continue
        if taken is not None:
            taken.append(np.array([(i, j, e)], np.int64))
        ids[i], ids[j], end[i], after[i] = known[ids[i], ids[j]][1], -1, e, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        pairs = [(before[i], i)] * (before[i] >= 0) + [(i, after[i])] * (after[i] >= 0)
        if pairs:
            offer(pairs)
    return [x for x in ids if x >= 0]


def _side_by_side(ids: np.ndarray, lengths: np.ndarray, table: PairTable, rate: float, keys: np.ndarray, taken: list | None = None) -> np.ndarray:
    """ids: a row per word, filled up with -1, as are the places of symbols that merged into the one before. A symbol stands where it begins."""
    n, width = ids.shape
    below, wide = threshold(rate), width + 1
    # one row of width + 1 places after the other
    after = np.minimum(np.arange(1, width + 2)[None, :], lengths[:, None]).astype(np.int32).reshape(-1)  # where the next symbol begins, or the word ends
    before = np.broadcast_to(np.arange(-1, width), (n, wide)).astype(np.int32).reshape(-1)
    rank, merged = np.full(n * wide, NEVER), np.full(n * wide, -1, np.int32)
    table_rows, symbols = rank.reshape(n, wide), np.c_[ids, np.full(n, -1, np.int32)].reshape(-1)

    def look(rows, at):
        """Sets the rank and the result of the pair that begins at each place."""
        start = rows * wide
        here, right = start + at, after[start + at]
        rank[here] = NEVER
        pair = np.flatnonzero(right < lengths[rows])
        rows, at, here, right, start = rows[pair], at[pair], here[pair], right[pair], start[pair]
        there = start + right
        found, symbol = table.find(symbols[here], symbols[there])
        some = np.flatnonzero(found != NEVER)
        if rate:
            kept = candidate_hash(keys[rows[some]], at[some], right[some], after[there[some]]) >= below
            some = some[kept]
        rank[here[some]], merged[here[some]] = found[some], symbol[some]

    look(np.repeat(np.arange(n), lengths - 1), ragged(np.zeros(n, np.int64), lengths - 1))
    alive = np.arange(n)
    while True:
        best = table_rows[alive].argmin(axis=1)
        start = alive * wide
        go = np.flatnonzero(rank[start + best] != NEVER)
        alive, best, start = alive[go], best[go], start[go]
        if not len(alive):
            return symbols.reshape(n, wide)
        here = start + best
        gone = after[here]
        following = after[start + gone]
        if taken is not None:
            taken.append((alive, place_hash(best, gone, following)))
        symbols[here], symbols[start + gone], rank[start + gone] = merged[here], -1, NEVER
        after[here], before[start + following] = following, best
        look(alive, best)
        earlier = before[here]
        some = np.flatnonzero(earlier >= 0)
        look(alive[some], earlier[some])


def merge_words(flat: np.ndarray, lengths: np.ndarray, table: PairTable, rate: float = 0.0, keys: np.ndarray | None = None, taken: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of words (one after the other in ``flat``) after merging, and how many each has.

    rate: the share of candidates to skip; keys: an unsigned 64-bit key per word. ``taken`` takes, in parts, the words' numbers and the place
    hashes of all candidates that were merged; at rate 0 a word whose key skips none of these merges alike at any rate, since a candidate that was never merged may as well be skipped.
    """
    lengths = np.asarray(lengths, np.int64)
    starts, n = np.cumsum(lengths) - lengths, len(lengths)
    keys = np.zeros(n, np.uint64) if keys is None else np.asarray(keys, np.uint64)
    out_lengths = np.zeros(n, np.int64)
    order = np.argsort(lengths, kind="stable")
    parts: list[np.ndarray] = []
    at = int(np.searchsorted(lengths[order], 1))
    short = int(np.searchsorted(lengths[order], LONG, "right"))
    done = [order[:at]]
    while at < short:
        to = min(short, at + max(1, CELLS // int(lengths[order[at]])))
        while to > at + 1 and (to - at) * int(lengths[order[to - 1]]) > 2 * CELLS:
            to = at + (to - at) // 2
        rows = order[at:to]
        size, width = lengths[rows], int(lengths[order[to - 1]])
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width)[None, :] < size[:, None]] = flat[ragged(starts[rows], size)]
        met = None if taken is None else []
        ids = _side_by_side(ids, size, table, rate, keys[rows], met)
        if taken is not None:
            taken.extend((rows[r], h) for r, h in met)
        parts.append(ids[ids >= 0])
        out_lengths[rows] = (ids >= 0).sum(1)
        done.append(rows)
        at = to
    for row in order[short:]:
        met = None if taken is None else []
        merged = _agenda(flat[starts[row] : starts[row] + lengths[row]], table, rate, int(keys[row]), met)
        if met:
            places = np.concatenate(met)
            taken.append((np.full(len(places), row), place_hash(*places.T)))
        parts.append(np.array(merged, np.int32))
        out_lengths[row] = len(merged)
        done.append(np.array([row]))
    shuffled = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    sequence = np.concatenate(done) if done else np.zeros(0, np.int64)
    place = np.zeros(n, np.int64)
    place[sequence] = np.cumsum(out_lengths[sequence]) - out_lengths[sequence]
    return shuffled[ragged(place, out_lengths)], out_lengths
