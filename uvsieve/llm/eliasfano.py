"""Elias-Fano sequences, and the three-level n-gram trie made of them."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

#: Values between two stored samples, and decoded at a time.
CHUNK = 1 << 15
#: Steps of the logarithmic scale for each halving of a probability.
SCALE = 2_048


class Sequence:
    """A rising sequence of unsigned numbers: low bits packed side by side, high bits in unary.

    The bytes lie in ``store``; only one value in ``CHUNK`` is kept outside."""

    def __init__(self, values: np.ndarray, store: Store):
        values = np.asarray(values, np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(self.n, 1)).bit_length() - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        marks = np.zeros((int(high[-1]) if self.n else 0) + self.n + 1, np.uint8)
        marks[high + np.arange(self.n)] = 1
        self.samples = values[::CHUNK].copy()
        self.mark_at = (high + np.arange(self.n))[::CHUNK].copy()
        self.marks_size = len(marks)
        self.marks = store.put(np.packbits(marks))
        self.lows: list[slice] = []
        for at in range(0, self.n, CHUNK):
            part = values[at : at + CHUNK]
            bits = ((part[:, None] >> np.arange(self.low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            self.lows.append(store.put(np.packbits(bits.reshape(-1))))
        self.store = store

    def chunk(self, k: int) -> np.ndarray:
        """Values k x CHUNK to (k+1) x CHUNK - 1."""
        first = k * CHUNK
        n = min(CHUNK, self.n - first)
        start = int(self.mark_at[k])
        stop = int(self.mark_at[k + 1]) if k + 1 < len(self.mark_at) else self.marks_size
        packed = self.store.get(self.marks)[start // 8 : -(-stop // 8)]
        ones = np.flatnonzero(np.unpackbits(packed)[start % 8 :])[:n] + start
        high = (ones - np.arange(first, first + n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.store.get(self.lows[k]))[: n * self.low_bits].reshape(n, self.low_bits)
        low = np.zeros(n, np.uint64)
        for b in range(self.low_bits):
            low |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return high | low

    def at(self, places: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        out = np.zeros(len(places), np.uint64)
        for k, rows in _by_chunk(places // CHUNK):
            out[rows] = self.chunk(k)[places[rows] - k * CHUNK]
        return out

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key the place of the first value not below it (the length if none), and whether it is the key."""
        place, equal = np.full(len(keys), self.n, np.int64), np.zeros(len(keys), bool)
        if not self.n:
            return place, equal
        chunks = np.maximum(np.searchsorted(self.samples, keys, "right") - 1, 0)
        for k, rows in _by_chunk(chunks):
            values, own = self.chunk(k), keys[rows]
            found = np.searchsorted(values, own)
            place[rows] = found + k * CHUNK
            inside = found < len(values)
            equal[rows[inside]] = values[found[inside]] == own[inside]
        return place, equal


class Level:
    """Small numbers beside a sequence, mapped like it."""

    def __init__(self, values: np.ndarray, store: Store):
        self.kind, self.where, self.store = values.dtype, store.put(values), store

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.store.get(self.where).view(self.kind)[places]


def _by_chunk(chunks: np.ndarray):
    order = np.argsort(chunks, kind="stable")
    ordered = chunks[order]
    if not len(ordered):
        return
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    for a, b in zip(starts, [*starts[1:], len(ordered)], strict=True):
        yield int(ordered[a]), order[a:b]


class Store:
    """Levels written one after the other to an unnamed file, then mapped; the file goes with the task."""

    def __init__(self):
        self.file, self.size, self.map = tempfile.TemporaryFile(), 0, None

    def put(self, array: np.ndarray) -> slice:
        raw = np.ascontiguousarray(array).view(np.uint8).reshape(-1)
        self.size += self.file.write(bytes(-self.size % 8))  # numbers begin where they can be mapped
        self.file.write(raw.tobytes())
        self.size += len(raw)
        return slice(self.size - len(raw), self.size)

    def get(self, where: slice) -> np.ndarray:
        if self.map is None:
            self.file.flush()
            self.map = np.frombuffer(mmap.mmap(self.file.fileno(), self.size, access=mmap.ACCESS_READ), np.uint8) if self.size else np.zeros(0, np.uint8)
        return self.map[where]


def quantised(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities on a logarithmic scale, rounded down; 0 stands for none."""
    with np.errstate(divide="ignore"):
        code = np.ceil(-np.log2(np.maximum(p, 1e-300)) * SCALE) + 1
    return np.where((p > 0) & (code < 65_536), code, 0).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp2(-(codes.astype(np.float64) - 1) / SCALE), 0.0)


#: Groups of contexts, by the power of two of what follows them, that have discounts of their own.
GROUPS = 64


def context_groups(total: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(total, 1)).astype(np.int64)


def counts_of_counts(counts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How often counts of 1 to 4 occur in each group of contexts. Those of several tries add up."""
    return np.stack([np.bincount(group[counts == k], minlength=GROUPS) for k in range(1, 5)], 1)


def discounts(n: np.ndarray) -> np.ndarray:
    """What is taken off counts of 1, 2 and more, for each group of contexts, from how often counts of 1 to 4 occur."""
    n = n.astype(np.float64)
    y = n[:, 0] / np.maximum(n[:, 0] + 2 * n[:, 1], 1)
    out = np.stack([k - (k + 1) * y * n[:, k] / np.maximum(n[:, k - 1], 1) for k in (1, 2, 3)], 1)
    few = n.sum(1) < 50
    out[few] = 0.75
    return np.clip(out, 0.02, [0.98, 1.9, 2.9])


#: Bits that name a successor within its context's range.
NAME_BITS = np.uint64(40)
#: Bits of a context's place beside a name; a level of more contexts is several sequences.
PLACE_BITS = 24


def by_count(counts: np.ndarray, context: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` contexts how many successors occur once, twice and more often: what the discounts are taken from."""
    return np.stack([np.bincount(context[np.minimum(counts, 3) == k], minlength=n) for k in (1, 2, 3)], 1)


def left_over(total: np.ndarray, times: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The share of each context that its discounts leave; all of it where nothing follows. Made of whole numbers, so that parts add up to the same."""
    taken = (times * off[context_groups(total)]).sum(1)
    return np.where(total > 0, np.clip(taken / np.maximum(total, 1), 0, 1), 1.0)


class Trie:
    """Words (by hash), their successors, and the successors of these pairs, with quantised discounted probabilities.

    Each level below the first is a rising sequence of (place of the context in the level above, name of the successor); pointers tell where the range of a context
    begins. All levels and their codes are mapped from a file."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, ...], triples: tuple[np.ndarray, ...], off: np.ndarray):
        """``pairs`` and ``triples``: places of contexts in the level above, names and counts, rising; ``off``: discounts of both orders."""
        store = Store()
        self.words, self.counts, self.levels = Sequence(words, store), Level(counts, store), []
        for total, (context, name, times), discount in zip((counts, pairs[2]), (pairs, triples), off, strict=True):
            share = (times - discount[context_groups(total)[context], np.minimum(times, 3) - 1]) / np.maximum(total[context], 1)
            pointers = np.searchsorted(context, np.arange(len(total) + 1))
            cuts = pointers[:: 1 << PLACE_BITS].tolist()
            keys = (context & ((1 << PLACE_BITS) - 1)).astype(np.uint64) << NAME_BITS | name
            runs = [(a, Sequence(keys[a:b], store)) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
            self.levels.append((Sequence(pointers, store), runs, Level(quantised(share), store)))
        self.rests = Level(quantised(left_over(pairs[2], by_count(triples[2], triples[0], len(pairs[2])), off[1])), store)
        self.times = Level(by_count(pairs[2], pairs[0], len(words)), store)

    def find_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.words.successor(words)

    def find(self, order: int, context: np.ndarray, known: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each name the place, whether it is there, and its code (0 if not): by successor search within the range of its context."""
        pointers, runs, codes = self.levels[order - 2]
        there, asked = known.copy(), context[known]
        place, equal = np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        keys = (asked & ((1 << PLACE_BITS) - 1)).astype(np.uint64)
        keys <<= NAME_BITS
        keys |= name[known]
        for run, own in [(0, slice(None))] if len(runs) == 1 else _by_chunk(asked >> PLACE_BITS):
            start, sequence = runs[run]
            place[own], equal[own] = sequence.successor(keys[own])
            place[own] += start
        del keys
        equal &= place >= pointers.at(asked).astype(np.int64)
        equal &= place < pointers.at(asked + 1).astype(np.int64)
        there[known], place = equal, place[equal]
        places, out = np.zeros(len(context), np.int32 if sum(s.n for _, s in runs) < 1 << 31 else np.int64), np.zeros(len(context), np.uint16)
        places[there], out[there] = place, codes.at(place)
        return places, there, out
