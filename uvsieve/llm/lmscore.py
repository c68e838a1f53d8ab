"""Language-model scores from an Elias-Fano n-gram trie.

The model interpolates three orders: p(w | t u) = a(t, u, w) + rest(t, u) * p(w | u), p(w | u) = a(u, w) + rest(u) * p(w), with a(...) a discounted
and quantised share of what follows a context, rest(...) what the shares leave, and p(w) the add-half unigram of the base score. A text
begins after an end; its first word has that end alone as context.

No machine holds the model. Documents are dealt into blocks; each block tells every shard of the vocabulary which of the shard's
words, pairs and triples that begin with them it holds and how often its training documents do (counted, sorted and packed, so what is frequent
costs a block one entry). A shard adds up what all blocks tell; how often counts of 1 to 4 occur is summed over all shards,
so that the discounts are the corpus's and not the shard's. With them a shard builds its trie - words, pointers and successors as
Elias-Fano levels, mapped from a file - and answers each block by successor search within the context's own range. With the
answers, packed in the same order, each block scores its documents.

Words are named by 64-bit hashes, successors of a word within its range by the hash's upper 40 bits. So are those of a pair of two frequent words; those of
other pairs, which are no more than the rarer word's tokens and so at most about a shard's share, by 24. A frequent word would make its shard too large, so it is
cut into parts by its successors, as many as it has times the share of a shard in a sample; parts are shards' words like any other, and what their
successors leave is added up by the block in whole numbers. The parts change who counts, not what is counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import eliasfano
from .common import crc_mod, mix64, ragged, slices, utf8
from .eliasfano import GROUPS, NAME_BITS, Trie, context_groups, counts_of_counts, discounts, left_over, restored
from .words import span_hashes, spans

LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
END = np.uint64(0x454E44)  # no word's hash but by a chance of 2^-64
#: Bits left out of the names of successors of pairs that aren't of two frequent words.
COARSE = np.uint64(16)
NAME_MASK = (np.uint64(1) << NAME_BITS) - np.uint64(1)
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Bytes of text that are parted into words at a time, and of messages that leave a task at a time.
RUN_BYTES = 1 << 20


#: Bytes of text, about, from which frequent words are told.
SAMPLE_BYTES = 16 << 20
#: Shards are dealt to tasks by number; their words are those whose hash falls into a range.
Parts = dict[int, int]


def tokens_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens - the words and the end of each text - and how many each text has."""
    starts, stops, owner = spans(data, ends, WHITE)
    n_tokens = np.bincount(owner, minlength=len(ends) - 1).astype(np.int64) + 1
    tokens = np.full(int(n_tokens.sum()), END, np.uint64)
    is_word = np.ones(len(tokens), bool)
    is_word[np.cumsum(n_tokens) - 1] = False
    tokens[is_word] = span_hashes(data, starts, stops)
    return tokens, n_tokens


def tokens_of_texts(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As `tokens_of`, of texts that come one after the other: no more than ``RUN_BYTES`` of them, or one text, are held at a time."""
    found, held, size = [], [], 0

    def settle():
        data = LOWER[np.frombuffer(b"".join(held), np.uint8)]
        found.append(tokens_of(data, np.r_[0, np.cumsum([len(t) for t in held])].astype(np.int64)))
        held.clear()

    for text in texts:
        held.append(text)
        size += len(text)
        if size >= RUN_BYTES:
            settle()
            size = 0
    if held:
        settle()
    tokens, n_tokens = zip(*found, strict=True)
    return np.concatenate(tokens), np.concatenate(n_tokens)


def number_kind(n: int) -> type:
    """The kind of numbers below ``n``: a block's or shard's take four bytes each, not eight."""
    return np.int32 if n < 1 << 31 else np.int64


def numbers(order: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different key stands (once), and the number of each key among them, from their order and which differ from the one before."""
    kind = number_kind(len(order))
    number = np.empty(len(order), kind)
    place = np.cumsum(fresh, dtype=kind)
    place -= 1
    number[order] = place
    return order[fresh].astype(kind), number


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, rising, where each stands (once), and the number of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.r_[True, ordered[1:] != ordered[:-1]] if len(keys) else np.zeros(0, bool)
    ordered = ordered[fresh]
    return ordered, *numbers(order, fresh)


def numbered_names(place: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `numbered`, of pairs of a place and a name: the different places and names, rising, where each stands, and each one's number."""
    if not len(place) or int(place.max()) >> eliasfano.PLACE_BITS == 0:
        keys = place.astype(np.uint64)
        keys <<= NAME_BITS
        keys |= name
        keys, first, number = numbered(keys)
        return (keys >> NAME_BITS).astype(place.dtype), keys & NAME_MASK, first, number
    order = np.lexsort((name, place))
    places, names = place[order], name[order]
    fresh = np.r_[True, (places[1:] != places[:-1]) | (names[1:] != names[:-1])]
    return places[fresh], names[fresh], *numbers(order, fresh)


def part_ids(words: np.ndarray, part: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.where(part == 0, words, mix64(words + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def frequent_names(frequent: Parts) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the frequent words' parts, and the names that the words have as successors: a pair of two frequent words has one of each."""
    words, parts = np.array(list(frequent), np.uint64), np.array(list(frequent.values()), np.int64)
    return part_ids(np.repeat(words, parts), ragged(np.zeros(len(words), np.int64), parts)), words >> (np.uint64(64) - NAME_BITS)


class Block:
    """The tokens of some texts as different words, pairs and triples.

    Words stand by rising hash; their parts, to which pairs belong, by rising id; pairs by part and the successor's name; triples by pair and name."""

    def __init__(self, texts: Iterable[bytes], frequent: Parts):
        tokens, self.n_tokens = tokens_of_texts(texts)
        self.words, _, self.token = numbered(tokens)
        del tokens  # arrays as long as the tokens are given up as soon as they can be
        n, names, kind = len(self.words), self.words >> (np.uint64(64) - NAME_BITS), self.token.dtype
        parts = np.array([frequent.get(w, 1) for w in self.words.tolist()], np.int64) if frequent else np.ones(n, np.int64)
        part = ragged(np.zeros(n, np.int64), parts)
        self.word = np.repeat(np.arange(n), parts)
        ids = part_ids(self.words[self.word], part)
        order = np.argsort(ids, kind="stable")
        self.ids, self.word, self.leads = ids[order], self.word[order], part[order] == 0
        place = np.empty(len(order), number_kind(len(order)))
        place[order] = np.arange(len(order))
        # pairs: each token after the one before it, the first of a text after an end
        before = np.empty(len(self.token), kind)
        before[0], before[1:] = np.searchsorted(self.words, END), self.token[:-1]
        head = np.cumsum(parts) - parts
        own = place[head][before]
        cut = np.flatnonzero((parts > 1)[before])
        lead = before[cut]
        own[cut] = place[head[lead] + (mix64(self.words)[self.token[cut]] % parts[lead].astype(np.uint64)).astype(np.int64)]
        del before, cut, lead
        self.part, self.pair_name, first, self.pair = numbered_names(own, names[self.token])
        del own
        self.successor = self.token[first]
        leads, ends = frequent_names(frequent)
        fine = np.isin(self.ids, leads)[self.part] & np.isin(names, ends)[self.successor]
        # triples: all but the first token of a text
        self.later = np.ones(len(self.token), bool)
        self.later[np.cumsum(self.n_tokens) - self.n_tokens] = False
        context, after = self.pair[:-1][self.later[1:]], self.token[self.later]
        name, sharp = (names >> COARSE << COARSE)[after], fine[context]
        name[sharp] = names[after[sharp]]
        del after, sharp, first
        self.context, self.triple_name, first, self.triple = numbered_names(context, name)
        del context, name
        self.inner, self.fine = self.pair[self.later][first], fine[self.context]

    def learned(self, training: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often the texts of ``training`` hold each part's word, each pair and each triple."""
        own = np.repeat(training, self.n_tokens)
        words = np.bincount(self.token[own], minlength=len(self.words))[self.word]
        pairs = np.bincount(self.pair[own], minlength=len(self.part))
        return words, pairs, np.bincount(self.triple[own[self.later]], minlength=len(self.context))


def shard_bounds(words: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards that hold any of the rising hashes, and where the words of each begin, and the end."""
    shard = (words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    some, first = np.unique(shard, return_index=True)
    return some.astype(np.int32), np.r_[first, len(words)]


def pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(packed: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    sizes = np.frombuffer(raw, np.int64, len(types))
    out, at = [], 8 * len(types)
    for n, t in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts as the eight planes of their bytes: empty ones pack to almost nothing."""
    return np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).reshape(-1)


def widened(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").reshape(-1)


def narrowest(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes each as the largest takes."""
    top = counts.max(initial=0)
    return counts.astype(next((k for k in (np.uint8, np.uint16, np.uint32) if top <= np.iinfo(k).max), np.int64))


def thin(names: np.ndarray, width: int) -> np.ndarray:
    """Names as so many bytes each."""
    return np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def thick(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def stepped(ids: np.ndarray) -> np.ndarray:
    """Rising ids as the planes of the bytes of their differences, which need fewer."""
    return np.ascontiguousarray(np.diff(ids, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).reshape(-1)


def summed(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1).astype(np.uint64), dtype=np.uint64)


def parted(codes: np.ndarray) -> np.ndarray:
    """16-bit codes as the planes of their bytes."""
    return np.ascontiguousarray(codes.astype("<u2").view(np.uint8).reshape(-1, 2).T).reshape(-1)


def joined(planes: np.ndarray) -> np.ndarray:
    return restored(np.ascontiguousarray(planes.reshape(2, -1).T).view("<u2").reshape(-1))


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for rows, column in slices(batch):
            data, ends = utf8(column)
            raw = data.tobytes()
            packed = [squeeze(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("block"), rows.column("doc_id"), rows.column("training"), pa.array(packed, pa.binary())], ["block", "doc_id", "training", "packed"])


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each block or shard, from rows in its order."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[0] != key:
                if held:
                    yield key, held
                held, key = [], row[0]
            held.append(row)
    if held:
        yield key, held


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, column in slices(batch):
            data, ends = utf8(column)
            words, counts = np.unique(tokens_of(LOWER[data], ends)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])


def frequent_words(texts: DataFrame, size: int, shards: int) -> Parts:
    """The parts of words with more than a shard's share of tokens, by a sample of about ``SAMPLE_BYTES``: at most as many words as shards."""
    one_in = max(1, size // SAMPLE_BYTES)
    words = texts.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(one_in)) == 0).select("text").mapInArrow(_token_rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n").alias("total"))
    found = words.crossJoin(F.broadcast(total)).where(F.col("n") * shards > F.col("total")).collect()
    return {r["word"] % 2**64: -(-r["n"] * shards // r["total"]) for r in found}


def _messages(first: str, second: str, rows: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Packed messages between blocks and shards, about ``RUN_BYTES`` at a time."""
    held, size = [], 0

    def settle():
        a, b, packed = zip(*held, strict=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(packed, pa.binary())], [first, second, "packed"])

    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= RUN_BYTES:
            yield settle()
            size = 0
    if held:
        yield settle()


def _questions(block: int, b: Block, counts: tuple[np.ndarray, np.ndarray, np.ndarray], shards: int) -> Iterator[tuple[int, int, bytes]]:
    """What a block tells and asks each shard."""
    word_counts, pair_counts, triple_counts = counts
    some, bounds = shard_bounds(b.ids, shards)
    first = np.searchsorted(b.part, bounds.astype(b.part.dtype))
    start = np.searchsorted(b.context, first.astype(b.context.dtype))
    fan, deep = np.bincount(b.part, minlength=len(b.ids)), np.bincount(b.context, minlength=len(b.part))
    for k, shard in enumerate(some.tolist()):
        w, p, t = slice(bounds[k], bounds[k + 1]), slice(first[k], first[k + 1]), slice(start[k], start[k + 1])
        names, fine = b.triple_name[t], b.fine[t]
        told = (stepped(b.ids[w]), b.leads[w], narrow(word_counts[w]), narrow(fan[w]), thin(b.pair_name[p], 5), narrow(pair_counts[p]), narrow(deep[p]), thin(names[~fine] >> COARSE, 3), thin(names[fine], 5), narrow(triple_counts[t]))
        yield shard, block, pack(*told)


def _asking(shards: int, frequent: Parts):
    """What each block tells and asks each shard."""

    def asked(block: int, rows: list[tuple]) -> Iterator[tuple[int, int, bytes]]:
        squeeze = zstandard.ZstdDecompressor().decompress
        b = Block((squeeze(r[2]) for r in rows), frequent)
        counts = b.learned(np.array([r[1] for r in rows], bool))
        del b.token, b.pair, b.triple, b.later, b.inner, b.successor  # the block's own business
        return _questions(block, b, counts, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _grouped(batches, ("block", "training", "packed")):
            yield from _messages("shard", "block", asked(block, rows))  # nothing of a block is left when the next one begins

    return run


def _summed(place: np.ndarray, name: np.ndarray, times: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The different places and names with a count, rising, with their summed counts, and the number of each one that has one."""
    seen = times > 0
    places, names, _, code = numbered_names(place[seen], name[seen])
    at = np.zeros(len(place), code.dtype)
    at[seen] = code
    return (places, names, np.bincount(code, times[seen], len(places)).astype(np.int64)), at


def _heard(packed: Iterable[bytes]) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """How many words, pairs and triples each block tells, with the sums before it, and all blocks' arrays of each sort."""
    ends, columns = [(0, 0, 0)], [[] for _ in range(9)]
    for x in packed:
        ids, leads, counts, fan, pair_names, pair_counts, deep, coarse, fine, triple_counts = unpack(x, *["u1"] * 10)
        told = summed(ids), leads.copy(), narrowest(widened(counts)), narrowest(widened(fan)), thick(pair_names, 5), narrowest(widened(pair_counts)), narrowest(widened(deep)), (thick(coarse, 3), thick(fine, 5)), narrowest(widened(triple_counts))
        ends.append((len(leads), len(told[4]), len(told[8])))
        for column, array in zip(columns, told, strict=True):
            column.append(array)
    return np.cumsum(ends, axis=0), columns


class Told:
    """What all blocks tell a shard, added up: words with their counts, and the pairs and triples seen with theirs."""

    def __init__(self, packed: Iterable[bytes], frequent: Parts):
        self.ends, columns = _heard(packed)
        join = lambda: np.concatenate(columns.pop(0))  # noqa: E731, each sort of array in turn
        self.ids, leads, counts, self.fan = join(), join(), join(), join()
        self.words, first, place = numbered(self.ids)
        self.counts = np.bincount(place, counts, len(self.words)).astype(np.int64)
        self.leads = leads[first] > 0
        pair_names = join()
        self.pairs, at = _summed(np.repeat(place, self.fan), pair_names, join())
        self.deep = join()
        frequent_leads, ends = frequent_names(frequent)
        fine = np.repeat(np.isin(self.ids, frequent_leads), self.fan)
        fine[fine] = np.isin(pair_names[fine], ends)
        fine = np.repeat(fine, self.deep)
        triple_names = np.empty(len(fine), np.uint64)
        coarse_names, fine_names = (np.concatenate(x) for x in zip(*columns.pop(0), strict=True))
        triple_names[~fine], triple_names[fine] = coarse_names << COARSE, fine_names
        del fine, coarse_names, fine_names
        self.names = pair_names, triple_names
        # a triple with a count has a pair with a count
        self.triples, _ = _summed(np.repeat(at, self.deep), triple_names, join())


def _surveying(frequent: Parts):
    """Per shard: how many tokens and different words it has (places 0 and 1), and how often counts of 1 to 4 occur in each group of contexts of both orders."""

    def counted(rows: list[tuple]) -> np.ndarray:
        t = Told((r[1] for r in rows), frequent)
        own = t.counts[t.leads]
        orders = [counts_of_counts(x[2], context_groups(total)[x[0]]).reshape(-1) for total, x in ((t.counts, t.pairs), (t.pairs[2], t.triples))]
        return np.concatenate([[own.sum(), (own > 0).sum()], *orders])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, ("shard", "packed")):
            n = counted(rows)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["place", "n"])

    return run


def surveyed(text: str | None) -> tuple[int, int, np.ndarray]:
    """Tokens, different words and both orders' discounts, from a survey."""
    n = np.zeros(2 + 8 * GROUPS, np.int64)
    for entry in filter(None, (text or "").split(",")):
        place, _, times = entry.partition(":")
        n[int(place)] = int(times)
    return int(n[0]), int(n[1]), np.stack([discounts(x) for x in n[2:].reshape(2, GROUPS, 4)])


def _answering(frequent: Parts):
    """What a shard answers each block."""

    def answered(rows: list[tuple]) -> Iterator[tuple[int, int, bytes]]:
        t = Told((r[2] for r in rows), frequent)
        trie = Trie(t.words, t.counts, t.pairs, t.triples, surveyed(rows[0][3])[2])
        del t.pairs, t.triples  # the trie has them, in its file
        # all blocks' questions at once, so that each part of a level is decoded once
        word, _ = trie.find_words(t.ids)  # all of them are there
        pair, known, codes = trie.find(2, np.repeat(word.astype(number_kind(len(t.words))), t.fan), np.ones(len(t.names[0]), bool), t.names[0])
        _, _, deeper = trie.find(3, np.repeat(pair, t.deep), np.repeat(known, t.deep), t.names[1])
        rests = np.ones(len(pair), np.uint16)  # 1 stands for all
        rests[known] = trie.rests.at(pair[known])
        counts, times = trie.counts.at(word), trie.times.at(slice(None)).reshape(-1, 3)[word]
        for r, low, high in zip(rows, t.ends[:-1], t.ends[1:], strict=True):
            w, p, d = (slice(a, b) for a, b in zip(low, high, strict=True))
            yield r[1], r[0], pack(narrow(counts[w]), *(narrow(times[w, k]) for k in range(3)), parted(codes[p]), parted(rests[p]), parted(deeper[d]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, ("shard", "block", "packed", "survey")):
            yield from _messages("block", "shard", answered(rows))

    return run


def _scoring(frequent: Parts):
    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        squeeze = zstandard.ZstdDecompressor().decompress
        n, v, off = surveyed(answers.column("survey")[0].as_py())
        b = Block((squeeze(x.as_py()) for x in own.column("packed")), frequent)
        del b.pair_name, b.triple_name, b.fine  # only questions have names
        told = [unpack(x, *["u1"] * 7) for _, x in sorted(zip(answers.column("shard").to_pylist(), answers.column("packed").to_pylist(), strict=True))]
        join = lambda k, f: np.concatenate([f(t[k]) for t in told])
        lead = np.empty(len(b.words), np.int64)
        lead[b.word[b.leads]] = np.flatnonzero(b.leads)
        counts = join(0, widened)[lead]
        times = np.stack([np.bincount(b.word, join(k, widened), len(b.words)) for k in (1, 2, 3)], 1)
        base = (counts + 0.5) / (n + 0.5 * (v + 1))
        inner = join(4, joined) + left_over(counts, times, off[0])[b.word[b.part]] * base[b.successor]
        outer = inner[b.inner]
        outer *= join(5, joined)[b.context]
        outer += join(6, joined)
        p = inner[b.pair]
        p[b.later] = outer[b.triple]
        del told, inner, outer, b.part, b.pair, b.successor, b.context, b.inner, b.triple, b.later
        owner = np.repeat(np.arange(own.num_rows), b.n_tokens)
        sums = lambda x: np.bincount(owner, x, own.num_rows)
        return pa.table(
            [own.column("doc_id"), pa.array(b.n_tokens), pa.array(sums(counts[b.token] > 0).astype(np.int64)), pa.array(np.full(own.num_rows, n)), pa.array(sums(np.log10(base)[b.token])), pa.array(sums(np.log10(np.maximum(p, 1e-300))))],
            ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def score_documents(documents: DataFrame, *, folds: int = 5, held_fold: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``documents(doc_id, text)``.

    It learns from the rows outside the held-out fold (a row without doc_id is scored, not learned from). A null text is empty: one token, the end. Rows that
    repeat count each time. Texts of any length are scored whole, an empty table gives an empty one. Where there is nothing to learn from, every probability is the base's. Other columns are not read.
    Scores depend neither on the blocks nor on the shards.
    """
    fold = crc_mod("doc_id", folds)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    session = rows.sparkSession
    partitions = int(session.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(partitions, -(-size // block_bytes))
    shards = blocks
    frequent = frequent_words(rows, size, shards)
    dealt = rows.withColumn("training", F.coalesce(fold != held_fold, F.lit(False))).withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(blocks)).cast("int"))
    # the three exchanges; each branch reads all columns, so that those read twice are shuffled once
    texts = dealt.mapInArrow(_pack_rows, "block int, doc_id long, training boolean, packed binary").repartition(blocks, "block")
    asked = texts.sortWithinPartitions("block").mapInArrow(_asking(shards, frequent), "shard int, block int, packed binary")
    heard = asked.repartitionById(shards, "shard")  # a shard to a task
    survey = heard.sortWithinPartitions("shard").mapInArrow(_surveying(frequent), "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    survey = F.broadcast(survey.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "place", "n"))), ",").alias("survey")))  # one row, at most 514 numbers
    answers = heard.crossJoin(survey).sortWithinPartitions("shard").mapInArrow(_answering(frequent), "block int, shard int, packed binary").repartition(blocks, "block").crossJoin(survey)
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scoring(frequent), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select("doc_id", F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
