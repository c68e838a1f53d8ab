"""Operators that work row by row: pieces, token counts, language, quality, pages' parts."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from uvsieve.llm import merges
from uvsieve.llm.langid import codewords, identify_language
from uvsieve.llm.pieces import Encoder, Pieces, decode_pieces, encode_pieces
from uvsieve.llm.quality import keep_good, score_quality
from uvsieve.llm.queries import tokenizer_path
from uvsieve.llm.tokencount import Counter, count_tokens, prove_whole

ODD = [
    "", "Hello  world\n\n  héllo\t x 日本  ", "   ", "\n", "a\n b\n\n c", "ﬁ ① Å", "x" * 300, "ab" * 500 + " " + "é" * 200, "😀 ́x", " \n \n  ", " a",
    "Σας ΟΔΟΣ", "a\x1cb c", "İstanbul ½²", "don't I'LL 's", "<|endoftext|>hi<|startoftext|>", "日本語 test", "a​b c　d", "ẛ̣ Å", "a<|endoftext|",
]
SCHEMA = "doc_id long, text string, lang string, n_pieces string"


def docs(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang[i] if lang else None, "clash") for i, t in enumerate(texts)], SCHEMA)


def test_pieces_without_dropout_are_the_models(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in encode_pieces(docs(spark, [*ODD, None]), path, rate=0).collect()}
    for i, t in enumerate(ODD):
        assert got[i]["pieces"] == model.encode(t), t
    assert got[len(ODD)]["pieces"] == [] and got[len(ODD)]["lossless"]


def test_dropout_is_seeded_varied_and_lossless(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    df = docs(spark, [*ODD, "thinking about merges " * 30])
    a, b, c = (encode_pieces(x, path, rate=0.2, seed=s) for x, s in ((df, 1), (df.repartition(3), 1), (df, 2)))
    pa, pb, pc = ({r["doc_id"]: r["pieces"] for r in x.collect()} for x in (a, b, c))
    assert pa == pb and pa != pc
    assert a.where("not lossless").count() == 0
    back = {r["doc_id"]: r["text"] for r in decode_pieces(a, path).collect()}
    assert [back[i] for i in range(len(ODD))] == ODD
    assert len(pa[len(ODD)]) > len(encode_pieces(df, path, rate=0).where(F.col("doc_id") == len(ODD)).first()["pieces"])


def test_agenda_and_rounds_agree(monkeypatch):
    pieces = Pieces(tokenizer_path("piece_bpe_32k.model"))
    texts = ["the quick brown fox jumps over lazy dogs " * 3, "internationalisation"]
    one = Encoder(pieces, 0.15, 3, 4).encode(np.arange(2), texts)
    monkeypatch.setattr(merges, "LONG", 2)
    two = Encoder(pieces, 0.15, 3, 4).encode(np.arange(2), texts)
    assert one[0].tolist() == two[0].tolist() and one[1].tolist() == two[1].tolist()


def test_token_counts_are_the_librarys(spark):
    path = tokenizer_path("word_bpe_49k.json")
    counter = Counter(path, prove_whole(path))
    rng = random.Random(7)
    letters = "abcdefgh éÉß'’.,!?1234567890\n\t−日本語ΣĲǅ"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    want = [len(e.ids) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]
    rows = {r["doc_id"]: r for r in count_tokens(docs(spark, [*texts, None]), path, limit=10).collect()}
    assert [rows[i]["n_tokens"] for i in range(len(texts))] == want
    assert all(rows[i]["n_bytes"] == len(t.encode()) and rows[i]["over_limit"] == (want[i] > 10) for i, t in enumerate(texts))
    assert (rows[len(texts)]["n_bytes"], rows[len(texts)]["n_tokens"]) == (0, 0)


def test_every_whole_token_is_one(spark):
    path = tokenizer_path("word_bpe_49k.json")
    whole = sorted(prove_whole(path))[::97]
    counter = Counter(path, frozenset())
    assert all(len(counter.tokenizer.encode(w, add_special_tokens=False).ids) == 1 for w in whole)
    assert all(unicodedata.normalize("NFC", w) == w for w in whole)


@pytest.mark.parametrize("n", [1, 2, 4, 6, 9, 30])
def test_codewords_differ(n):
    code = codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n


def language_docs(spark, n=400):
    rng = random.Random(1)
    parts = {"aa": ["tha", "ing", "er"], "bb": ["sch", "ung", "lich"], "cc": ["eau", "que", "oi"]}
    lang = [rng.choice([*parts]) for _ in range(n)]
    texts = [" ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(12)) for k in lang]
    return texts, lang


def test_language_held_out_and_odd_rows(spark):
    texts, lang = language_docs(spark)
    texts += [None, "", "123 !!", "tha"]
    lang += [None] * 4
    rows = {r["doc_id"]: r for r in identify_language(docs(spark, texts, lang)).collect()}
    held = [i for i in range(400) if rows[i]["held_out"]]
    assert len(held) > 80 and np.mean([rows[i]["lang_pred"] == lang[i] for i in held]) > 0.97
    assert [rows[i]["lang_pred"] for i in (400, 401, 402)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[402]["ambiguous"] and rows[402]["score"] == 0


def test_language_with_nothing_to_learn(spark):
    rows = identify_language(docs(spark, ["abc", None])).collect()
    assert [r["lang_pred"] for r in rows] == ["und", "und"]
    assert identify_language(docs(spark, ["abc"]).limit(0)).count() == 0


def quality_tables(spark, n=300):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["river", "stone", "window", "garden", "letter"]) + rng.choice("abc") for _ in range(60)) for _ in range(n)]
    bad = [" ".join(rng.choice(["BUY", "NOW", "$$$", "###", "CLICK"]) + rng.choice("xyz") for _ in range(60)) for _ in range(n // 3)]
    texts, quality = good + bad, [1] * len(good) + [0] * len(bad)
    labels = spark.createDataFrame([(i, q) for i, q in enumerate(quality)] + [(5, None), (None, 1), (10**6, 0), (7, 3)], "doc_id long, quality int")
    return texts, quality, labels


def test_quality_held_out(spark):
    texts, quality, labels = quality_tables(spark)
    df = docs(spark, [*texts, None, ""])
    rows = {r["doc_id"]: r for r in score_quality(df, labels).collect()}
    assert np.mean([rows[i]["predicted"] == q for i, q in enumerate(quality) if rows[i]["held_out"]]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values()) and len(rows) == len(texts) + 2
    kept = keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in rows.values())


def test_quality_with_one_class_and_empty(spark):
    df = docs(spark, ["abc", None])
    rows = score_quality(df, spark.createDataFrame([(0, 1)], "doc_id long, quality int")).collect()
    assert len({r["score"] for r in rows}) == 1 and rows[0]["score"] >= 0.5
    assert score_quality(df.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_marks_in_texts_and_long_texts_decode_exactly(spark):
    """A text's own mark letters, a word of many symbols, a long text, repeated and null rows."""
    rows = [(1, "a▁b ▁▁ c▁"), (1, "a▁b ▁▁ c▁"), (2, "▁"), (3, "ab" * 3000), (4, "word " * 500_000), (None, None), (5, "\n \n  x")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, pieces_of string")
    model = tokenizer_path("piece_bpe_32k.model")
    for rate in (0.0, 0.3):
        got = encode_pieces(df, model, rate=rate)
        assert got.where("not lossless").count() == 0 and got.count() == len(rows)
        back = sorted(r["text"] for r in decode_pieces(got, model).collect())
        assert back == sorted(t or "" for _, t in rows)


def test_rounds_agree_with_the_agenda_on_many_words(monkeypatch):
    """Words of all lengths under many keys: side by side and through the agenda, with the same merges taken."""
    rng = np.random.default_rng(5)
    n = 40
    left, right = (x.reshape(-1) for x in np.meshgrid(np.arange(n), np.arange(n)))
    some = rng.random(n * n) < 0.5
    table = merges.PairTable(left[some], right[some], rng.integers(0, 50, int(some.sum())), rng.integers(0, n, int(some.sum())))
    lengths = rng.integers(0, 30, 3000)
    flat, keys = rng.integers(0, 6, int(lengths.sum())).astype(np.int32), rng.integers(0, 2**63, 3000).astype(np.uint64)
    for rate in (0.0, 0.2, 1.0):
        taken = []
        a = merges.merge_words(flat, lengths, table, rate, keys, taken)
        monkeypatch.setattr(merges, "LONG", 0)
        other = []
        b = merges.merge_words(flat, lengths, table, rate, keys, other)
        monkeypatch.undo()
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
        pairs = lambda x: sorted(zip(*(np.concatenate(y).tolist() for y in zip(*x, strict=True)), strict=True)) if x else []
        assert pairs(taken) == pairs(other)
