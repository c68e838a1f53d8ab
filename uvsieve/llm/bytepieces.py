"""Byte-level BPE through a sentencepiece model that is serialised from the vocabulary alone.

A rank file lists byte strings by rank. Each byte is written as one letter, so that every string becomes a piece of
letters; pieces are scored by their negative rank and the normaliser is the identity. A model of the merge type then joins, best
score first and leftmost first among equals, exactly what byte-level BPE joins by rank. Texts are cut into pre-tokens by the
vocabulary's pattern, each pre-token is encoded alone, and pieces decode by mapping their letters back to bytes.

A pre-token that is a string of the vocabulary is one token by definition, even where merges don't lead to it; such strings are
found when the model is read, by encoding the whole vocabulary.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, slices
from .pieces import Runs
from .tokencount import byte_letters

#: Pre-tokens a worker remembers before it starts afresh; bounds memory, not results.
MEMORY_WORDS = 400_000
#: Ids that are decoded at a time.
STEP = 200_000
UNKNOWN = "<unk>"
#: Fixed values of the serialised model: the merge type of trainer, and the types of plain and of unknown pieces.
BPE, NORMAL, UNKNOWN_TYPE = 2, 1, 2


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, in order of rank; ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as file:
        pairs = sorted((int(rank), base64.b64decode(word)) for word, rank in (line.split() for line in file if line.strip()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not 0, 1, 2 and so on")
    return [word for _, word in pairs]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, content: bytes) -> bytes:
    """A field of bytes in protocol buffer form."""
    return _varint(number << 3 | 2) + _varint(len(content)) + content


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(ranks: list[bytes]) -> bytes:
    """A sentencepiece model of the vocabulary: pieces of byte letters numbered and scored by rank, and an unknown piece behind them, which nothing is encoded as
    as long as all 256 bytes are in the vocabulary."""
    if len({w for w in ranks if len(w) == 1}) != 256:
        raise ValueError("the vocabulary lacks single bytes")
    letters = {b: c for c, b in byte_letters().items()}

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _flag(3, kind))

    pieces = [piece("".join(letters[b] for b in word), -float(rank), NORMAL) for rank, word in enumerate(ranks)]
    trainer = _flag(3, BPE) + _flag(40, len(ranks))  # the type, and the unknown piece's number
    plain = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)  # no leading blank, blanks kept and not escaped
    return b"".join(pieces) + piece(UNKNOWN, 0.0, UNKNOWN_TYPE) + _field(2, trainer) + _field(3, plain)


class ByteModel:
    """A serialised model with tables for encoding and decoding."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        to_byte = byte_letters()
        self.letters = {b: c for c, b in to_byte.items()}
        n = self.model.get_piece_size() - 1
        names = [self.model.id_to_piece(i) for i in range(n)]
        content = [bytes(map(to_byte.__getitem__, name)) for name in names]
        self.content_length = np.array([len(c) for c in content], np.int64)
        self.content_start = np.cumsum(self.content_length) - self.content_length
        self.content = np.frombuffer(b"".join(content), np.uint8)
        #: Strings of the vocabulary that merges don't lead to.
        self.whole = {name: i for i, (name, ids) in enumerate(zip(names, self.model.encode(names, num_threads=1), strict=True)) if ids != [i]}

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after the other, and how many each has."""
        named = [w.encode().decode("latin-1").translate(self.letters) for w in words]
        ids = self.model.encode(named, num_threads=1)
        if self.whole:
            ids = [[self.whole[name]] if name in self.whole else own for name, own in zip(named, ids, strict=True)]
        return np.fromiter((i for own in ids for i in own), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def decode(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, one after the other, and how many each has."""
        size = self.content_length[flat]
        return self.content[ragged(self.content_start[flat], size)], size


class Encoder:
    """Encodes texts; remembers the ids of the pre-tokens met so far."""

    def __init__(self, model: ByteModel, pattern: str):
        self.model, self.find = model, regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.known = Runs(np.int32)

    def encode(self, documents: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if len(self.rows) > MEMORY_WORDS or self.known.used > 16 * MEMORY_WORDS:
            self.forget()
        split = [self.find(t) for t in documents]
        words = [w for s in split for w in s]
        if new := list(set(words).difference(self.rows)):
            self.known.add(*self.model.encode_words(new))
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        row = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        ends = np.r_[0, np.cumsum([len(s) for s in split], dtype=np.int64)]
        upto = np.r_[0, np.cumsum(self.known.size[row])]
        return self.known.take(row), np.diff(upto[ends])


def encode_bytes(documents: DataFrame, model: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of every row of ``documents(doc_id, text)`` under a model from ``serialise``.

    Texts are cut by ``pattern``; strings of special tokens are plain text. Null and empty texts have no ids; a null doc_id stays null; a text of any length is encoded
    whole; repeated rows give equal results; an empty table gives an empty one; other columns are not read. Nothing is shuffled, and each row depends on itself alone.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ByteModel(sent.value), pattern)
        for batch in batches:
            for part, column in slices(batch):
                flat, count = encoder.encode(column.to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), ids], ["doc_id", "n_tokens", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode_bytes(encoded: DataFrame, model: bytes) -> DataFrame:
    """``encoded`` with ``data``, the bytes that its ``ids`` stand for (binary; of null or no ids: empty). Other columns come along; one named ``data`` is replaced."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary
    rows = encoded.drop("data")
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = ByteModel(sent.value)
        for batch in batches:
            ends = np.r_[0, np.cumsum(batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)]
            at = 0
            while at < len(batch):  # rows with about STEP ids together; a longer one stands alone, and is decoded in steps
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP, "right")) - 1)
                part = batch.slice(at, to - at)
                flat = part.column("ids").flatten().to_numpy(zero_copy_only=False)
                raw = b"".join(tables.decode(flat[k : k + STEP])[0].tobytes() for k in range(0, len(flat), STEP))
                upto = np.r_[0, np.cumsum(tables.content_length[flat])][ends[at : to + 1] - ends[at]].tolist()
                decoded = pa.array([raw[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*names, "data"])
                at = to

    return rows.mapInArrow(run, schema)
