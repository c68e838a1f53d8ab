"""Dropout is drawn for each occurrence of a word."""

import random
from collections import Counter

import numpy as np

from uvsieve.llm import merges
from uvsieve.llm.pieces import UNIT, Encoder, Pieces, encode_pieces
from uvsieve.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def test_a_word_has_more_cuts_than_a_pool_of_keys(spark):
    df = spark.createDataFrame([(k, "internationalisation") for k in range(600)], "doc_id long, text string")
    cuts = Counter(tuple(r["pieces"]) for r in encode_pieces(df, PATH, rate=0.1).collect())
    assert len(cuts) > 8


def test_a_short_word_is_dropped_at_the_rate():
    pieces = Pieces(PATH)
    flat, size = Encoder(pieces, 0.1, 5).encode(np.arange(4000), ["a" for _ in range(4000)])
    whole, _ = pieces.encode_units([" a"], np.zeros(1, np.uint64), 0.0)
    assert len(whole) == 1 and 0.08 < (size > 1).mean() < 0.12


def test_only_varied_occurrences_need_encoding_again(monkeypatch):
    pieces, rng = Pieces(PATH), random.Random(4)
    texts = [" ".join(rng.choice(["the", "internationalisation", "thinking", "日本語é", "a", "x" * 150, "foxes  jump\n"]) for _ in range(60)) for _ in range(40)]
    for long in (merges.LONG, 3):
        monkeypatch.setattr(merges, "LONG", long)
        encoder = Encoder(pieces, 0.1, 9)
        fast = encoder.encode(np.arange(40), texts)
        assert 0 < len(encoder.varied(np.arange(len(encoder.rows)), np.arange(len(encoder.rows)).astype(np.uint64)))
        monkeypatch.setattr(Encoder, "varied", lambda self, row, keys: np.arange(len(row)))
        every = Encoder(pieces, 0.1, 9).encode(np.arange(40), texts)
        monkeypatch.undo()
        assert fast[0].tolist() == every[0].tolist() and fast[1].tolist() == every[1].tolist()
        assert sum(len(UNIT.findall(" " + t)) for t in texts) <= len(fast[0])
