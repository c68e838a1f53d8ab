"""Token counts by a whole-token shortcut.

A vocabulary string is *whole* when the tokenizer, given that string alone, returns exactly one
token. That set is proved once, offline, by encoding every word-final vocabulary string. When a
text is counted, each pre-token in the set counts as one without any merging; only the other
pre-tokens are merged, and the cost of each different word is worked out once per worker.

Special strings inside a text are matched before anything else and count as one token each, as
the library does by default.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8
from .merges import PairTable, merge_words

#: Words whose cost a worker remembers before it starts afresh; bounds memory, not results.
MEMORY_WORDS = 800_000
WORD_END = "</w>"
#: Fixed values of the tokenizer file: its pre-token pattern and white space.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
WHITE = regex.compile(r"\p{White_Space}+")
#: Python's split() also parts texts at these four, which are not white space to the tokenizer.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole(path: str) -> frozenset[str]:
    """The vocabulary strings that the tokenizer encodes, alone, as one token."""
    tokenizer, letters = load(path), byte_letters()
    words = []
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        if piece.endswith(WORD_END):
            raw = bytes(letters[c] for c in piece[: -len(WORD_END)] if c in letters)
            try:
                words.append(raw.decode())
            except UnicodeDecodeError:
                continue
    words = [w for w in words if PRE_TOKEN.findall(lowered(w)) == [w]]
    encoded = tokenizer.encode_batch(words, add_special_tokens=False)
    return frozenset(w for w, e in zip(words, encoded, strict=True) if len(e.ids) == 1)


def lowered(word: str) -> str:
    """NFC, then lower case letter by letter (a final sigma is not special)."""
    return word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()


class Counter:
    """Counts the tokens of texts; holds the costs of the words met so far."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer, self.whole, self.cost = load(path), whole, {"": 0}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, letters = model["vocab"], {b: c for c, b in byte_letters().items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocabulary[p[i]] for p in pairs]) for i in (0, 1))
        self.table = PairTable(left, right, np.arange(len(pairs)), np.array([vocabulary[a + b] for a, b in pairs]))
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocabulary[letters[b] + WORD_END] for b in range(256)], np.int32)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def learn(self, words: set[str]) -> None:
        """Finds the costs of words: whole pre-tokens count one, the rest are merged together in one batch."""
        parts = {w: PRE_TOKEN.findall(lowered(w)) for w in words}
        rest = list({p for ps in parts.values() for p in ps if p not in self.whole})
        merged = dict(zip(rest, self.merge(rest), strict=True))
        for word, pieces in parts.items():
            self.cost[word] = sum(merged.get(p, 1) for p in pieces)

    def merge(self, pieces: list[str]) -> list[int]:
        """Tokens of pre-tokens: their bytes' symbols, the last with the word end, merged."""
        raw = [p.encode() for p in pieces]
        lengths = np.array([len(x) for x in raw], np.int64)
        joined = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[joined]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[joined[last]]
        return merge_words(symbols, lengths, self.table)[1].tolist()

    def counts(self, documents: list[str]) -> list[int]:
        extra, split = [0] * len(documents), []
        for i, text in enumerate(documents):
            if self.special is not None and "<|" in text:
                text, extra[i] = self.special.subn(" ", text)
            split.append(WHITE.split(text) if SEPARATORS.search(text) else text.split())
        words = set().union(*split)
        if len(self.cost) > MEMORY_WORDS:
            self.cost = {"": 0}
        if missing := words.difference(self.cost):
            self.learn(missing)
        cost = self.cost
        return [n + sum(map(cost.__getitem__, ws)) for n, ws in zip(extra, split, strict=True)]


def count_tokens(documents: DataFrame, tokenizer: str, *, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``documents(doc_id, text)``.

    A null text is empty: 0 bytes and tokens. Repeated rows give repeated results; a row without doc_id keeps a null one; texts of any
    length are counted whole; an empty table gives an empty one; other columns are not read. ``tokenizer`` is the path of a byte-level tokenizer file with word ends, readable by
    every executor. Nothing is shuffled.
    """
    whole = documents.sparkSession.sparkContext.broadcast(prove_whole(tokenizer))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer, whole.value)
        for batch in batches:
            for rows, column in slices(batch):
                n_tokens = counter.counts(column.to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(utf8(column)[1])), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


