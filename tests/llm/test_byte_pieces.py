"""Byte-level BPE through a serialised model, against the library that the rank file is made for, and back again."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from uvsieve.llm.bytepieces import ByteModel, Encoder, decode_bytes, encode_bytes, read_ranks, serialise
from uvsieve.llm.queries import QUERIES, tokenizer_path

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "\n\n  x", "it's we'll I'D", "a\x1cb\x85c\xa0d", "日本語 é ﬁ 😀 ́x", "<|endoftext|> <|x|>", "▁ ▁▁", "\x00\x01", "x" * 3000, " " * 500 + "y", "aé" * 2000, "1234567890 ١٢٣"]
SCHEMA = "doc_id long, text string, ids string, data string, n_tokens double"


@pytest.fixture(scope="module")
def model():
    return serialise(read_ranks(PATH))


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(model, texts):
    flat, count = Encoder(ByteModel(model), public_tokenizers.PATTERN).encode(texts)
    ids = flat.tolist()
    ends = [0, *count.cumsum().tolist()]
    return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_ids_are_the_librarys(model, library):
    draw = random.Random(5)
    letters = [chr(c) for c in (*range(32, 127), 9, 10, 13, 0x1C, 0x85, 0xA0, 0xE9, 0xDF, 0x3B1, 0x416, 0x5D0, 0x661, 0x4E2D, 0x1F600, 0x301, 0x200B, 0x2028, 0x3000)]
    texts = ODD + ["".join(draw.choices(letters, k=draw.randint(1, 80))) for _ in range(3000)] + [f"a{chr(c)}1 {chr(c)}" for c in range(0, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    assert encoded(model, texts) == [library.encode_ordinary(t) for t in texts]


def test_ids_decode_to_the_bytes(model):
    tables = ByteModel(model)
    for ids, text in zip(encoded(model, ODD), ODD, strict=True):
        assert tables.decode(np.array(ids, np.int64))[0].tobytes() == text.encode()


def test_a_string_that_merges_do_not_reach_is_one_token():
    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"xyz"]  # xyz comes from no pair
    small = serialise(ranks)
    whole = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks={w: i for i, w in enumerate(ranks)}, special_tokens={})
    texts = ["xyz", "xyzx", "abab xyz", "x y z"]
    flat, count = Encoder(ByteModel(small), r"\S+|\s+").encode(texts)
    assert flat.tolist() == [i for t in texts for i in whole.encode_ordinary(t)] and count.tolist() == [len(whole.encode_ordinary(t)) for t in texts]
    with pytest.raises(ValueError):
        serialise(ranks[1:])


def test_odd_rows(spark, model, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no number"), (None, None), (50, None), (3, ODD[3]), (60, " ".join(f"n{k * 7919 % 1_000_003}" for k in range(300_000)))]
    df = spark.createDataFrame([(i, t, "a", "b", 0.5) for i, t in rows], SCHEMA)
    got = decode_bytes(encode_bytes(df, model, public_tokenizers.PATTERN), model).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r["ids"]), bytes(r["data"])) for r in got) == sorted((i if i is not None else -1, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert decode_bytes(encode_bytes(df.limit(0), model, public_tokenizers.PATTERN), model).count() == 0
    without = decode_bytes(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), model).first()
    assert bytes(without["data"]) == b""


def test_query_over_the_whole_table(spark, library):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op13_byte_pieces"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r["text"])
        assert got[r["doc_id"]] == (len(ids), hexed(",".join(map(str, ids)).encode()), hexed(r["text"].encode()))
