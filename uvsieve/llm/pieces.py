"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding follows the merge type of model: the text gets a leading mark, blanks become marks, and neighbouring
symbols whose concatenation is a piece are merged, best score first. With a dropout rate, a candidate merge is
skipped when its keyed hash falls below the rate, so a word is cut differently from place to place, yet always
alike for the same seed, document and place. Pieces joined again give the text back.

No piece holds a mark after another letter, or a line feed; that is proved when the model is read. Hence
units - marks with the letters after them, and line feeds - never interact and are encoded apart. Every occurrence has a key of its
own, of seed, document and place. A unit is encoded without dropout once per worker; only occurrences whose key skips a candidate
merged on that way are encoded again, and the others would come out the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, ragged, slices, utf8
from .merges import PairTable, merge_words, threshold

MARK = "▁"
#: Units a worker remembers before it starts afresh; bounds memory, not results.
MEMORY_UNITS = 400_000
#: Occurrences whose candidates are looked at at a time.
STEP = 100_000
UNIT = re.compile("\n| *[^ \n]+| +")
BYTE = re.compile("<0x([0-9A-F]{2})>")


class Pieces:
    """A model's pieces, as tables for encoding and decoding."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece of this model crosses units")
        self.byte_ids = np.zeros(256, np.int32)
        content = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                value = int(BYTE.fullmatch(names[i])[1], 16)
                self.byte_ids[value], content[i] = i, bytes([value])
        for p, i in self.ids.items():
            content[i] = p.replace(MARK, " ").encode()
        self.content_length = np.array([len(c) for c in content], np.int64)
        self.content_start = np.cumsum(self.content_length) - self.content_length
        self.content = np.frombuffer(b"".join(content), np.uint8)
        left, right, score, merged = [], [], [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), score.append(-model.get_score(i)), merged.append(i)
        self.table = PairTable(np.array(left), np.array(right), np.unique(np.array(score), return_inverse=True)[1], np.array(merged))
        #: A letter that is no piece stands as this number plus its code point until it is spelt in bytes.
        self.foreign = n

    def encode_units(self, units: list[str], keys: np.ndarray, rate: float, taken: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(units)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        distinct, code = np.unique(points, return_inverse=True)
        # a blank is a mark; a mark in the text itself is spelt in bytes, or it would come back as a blank
        symbols = np.array([self.ids.get(MARK if c == 32 else chr(c), self.foreign + int(c)) if c != ord(MARK) else self.foreign + int(c) for c in distinct.tolist()], np.int32)[code]
        flat, count = merge_words(symbols, lengths, self.table, rate, keys, taken)
        foreign = np.flatnonzero(flat >= self.foreign)
        if len(foreign):
            owner = np.repeat(np.arange(len(units)), count)
            spelt = [chr(int(c) - self.foreign).encode() for c in flat[foreign]]
            size = np.ones(len(flat), np.int64)
            size[foreign] = [len(s) for s in spelt]
            wide, at = np.repeat(flat, size), np.cumsum(size) - size
            wide[ragged(at[foreign], size[foreign])] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
            flat, count = wide, np.bincount(owner, size, len(units)).astype(np.int64)
        return flat, count


class Runs:
    """Runs of numbers, one after the other."""

    def __init__(self, kind):
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, kind), 0

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        if self.used + len(flat) > len(self.pool):
            self.pool = np.r_[self.pool[: self.used], np.zeros(max(len(flat), len(self.pool)), self.pool.dtype)]
        self.pool[self.used : self.used + len(flat)] = flat
        self.start, self.size = np.r_[self.start, self.used + np.cumsum(size) - size], np.r_[self.size, size]
        self.used += len(flat)

    def take(self, rows: np.ndarray) -> np.ndarray:
        return self.pool[ragged(self.start[rows], self.size[rows])]


class Encoder:
    """Encodes documents; remembers the units met so far: their pieces without dropout, and the candidates merged on the way there."""

    def __init__(self, pieces: Pieces, rate: float, seed: int, variants: int | None = None):
        self.pieces, self.rate, self.seed, self.variants = pieces, rate, seed, variants
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.whole, self.taken = Runs(np.int32), Runs(np.uint64)

    def learn(self, units: list[str]) -> None:
        """Encodes each unit without dropout."""
        taken: list[tuple[np.ndarray, np.ndarray]] | None = [] if self.rate else None
        self.whole.add(*self.pieces.encode_units(units, np.zeros(len(units), np.uint64), 0.0, taken))
        owner, places = (np.concatenate(x) for x in zip(*taken, strict=True)) if taken else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.taken.add(places[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(units)))
        self.rows.update(zip(units, range(len(self.rows), len(self.rows) + len(units)), strict=True))

    def varied(self, row: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The occurrences that skip a candidate merged without dropout."""
        below, found = threshold(self.rate), []
        for at in range(0, len(row), STEP):
            part = row[at : at + STEP]
            n = self.taken.size[part]
            skip = mix64(np.repeat(keys[at : at + STEP], n) ^ self.taken.take(part)) < below
            hit = np.zeros(len(part), bool)
            hit[np.repeat(np.arange(len(part)), n)[skip]] = True
            found.append(at + np.flatnonzero(hit))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def encode(self, ids: np.ndarray, documents: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The piece numbers of all documents, one after the other, and how many each has."""
        if len(self.rows) > MEMORY_UNITS or max(self.whole.used, self.taken.used) > 16 * MEMORY_UNITS:
            self.forget()
        split = [UNIT.findall(" " + t) if t else [] for t in documents]
        count = np.fromiter(map(len, split), np.int64, len(split))
        units = [u for s in split for u in s]
        if new := list(set(units).difference(self.rows)):
            self.learn(new)
        row = np.fromiter(map(self.rows.__getitem__, units), np.int64, len(units))
        size = self.whole.size[row]
        redone = np.zeros(0, np.int64)
        if self.rate:
            with np.errstate(over="ignore"):
                place = ragged(np.zeros(len(count), np.int64), count).astype(np.uint64)
                document = np.repeat(mix64(ids.view(np.uint64) ^ np.uint64(self.seed % 2**64)), count)
                keys = mix64(document + place * np.uint64(0x9E3779B97F4A7C15))
                if self.variants:
                    names = np.array([xxhash.xxh3_64_intdigest(u) for u in units], np.uint64)
                    keys = mix64(names ^ mix64(keys % np.uint64(self.variants) + np.uint64(self.seed % 2**64)))
            redone = self.varied(row, keys)
        if len(redone):
            again, size[redone] = self.pieces.encode_units([units[k] for k in redone.tolist()], keys[redone], self.rate)
        at = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.int32)
        same = np.ones(len(row), bool)
        same[redone] = False
        flat[ragged(at[same], size[same])] = self.whole.take(row[same])
        if len(redone):
            flat[ragged(at[redone], size[redone])] = again
        ends = np.r_[0, np.cumsum(count)]
        return flat, np.diff(np.r_[0, np.cumsum(size)][ends])


def decode(pieces: Pieces, flat: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The bytes of each document's pieces, without the leading blank."""
    size = pieces.content_length[flat]
    joined = pieces.content[ragged(pieces.content_start[flat], size)].tobytes()
    ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(lengths)]].tolist()
    return [joined[a + 1 : b] if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode_pieces(documents: DataFrame, model: str, *, rate: float = 0.1, seed: int = 17, variants: int | None = None, carry: bool = False) -> DataFrame:
    """doc_id, n_pieces, pieces (array of piece numbers) and lossless of every row of ``documents(doc_id, text)``.

    ``lossless``: the pieces were decoded again and gave the text. A text's own mark letters are spelt in bytes, so that holds for them too (the model's own encoder
    takes them for blanks). Null and empty texts have no pieces. At rate 0 the pieces are else those of the model's own encoder. Repeated
    rows give equal results, a null doc_id counts as 0; other columns are not read; nothing is shuffled.
    ``model`` is a merge-type model's path that every executor can read. Dropout is drawn for each occurrence of a unit; with ``variants``, from so many keys only.
    With ``carry``, all columns of ``documents`` come along (their names must differ from the three added ones).
    """

    rows = documents.withColumn("doc_id", F.col("doc_id").cast("long")) if carry else documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept = [n for n in rows.columns if carry or n == "doc_id"]
    schema = T.StructType([f for f in rows.schema.fields if f.name in kept] + list(T._parse_datatype_string("n_pieces long, pieces array<int>, lossless boolean").fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        encoder = Encoder(pieces, rate, seed, variants)
        for batch in batches:
            for part, column in slices(batch):
                ids = part.column("doc_id").fill_null(0).to_numpy()
                flat, lengths = encoder.encode(ids, column.to_pylist())
                data, ends = utf8(column)
                back = decode(pieces, flat, lengths)
                raw = data.tobytes()
                lossless = [b == raw[s:e] for b, s, e in zip(back, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                arrays = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(lengths), arrays, pa.array(lossless)], [*kept, "n_pieces", "pieces", "lossless"])

    return rows.mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row of ``encoded(doc_id, pieces)``; null or empty pieces give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            lists = batch.column("pieces")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            back = decode(pieces, flat, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b.decode(errors="replace") for b in back])], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "pieces").mapInArrow(run, "doc_id long, text string")
