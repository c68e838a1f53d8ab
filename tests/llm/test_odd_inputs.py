"""Every operator on documents with nulls, empty and very long texts, repeated rows, ties, clashing columns, and on empty tables."""

import hashlib

import pytest

from uvsieve.llm.decontaminate import drop_leaked, leaks
from uvsieve.llm.digest import edited, fingerprints
from uvsieve.llm.langid import identify_language
from uvsieve.llm.lmscore import score_documents
from uvsieve.llm.minhash import near_duplicates
from uvsieve.llm.pieces import encode_pieces
from uvsieve.llm.quality import score_quality
from uvsieve.llm.queries import tokenizer_path
from uvsieve.llm.repeats import remove_repeats
from uvsieve.llm.tokencount import count_tokens

#: Beyond what one numpy step handles, in letters and as one word.
LONG = " ".join(f"n{k * 7919 % 1_000_003}" for k in range(600_000))
WORD = "abcdefghij" * 20_000
ITEM = "how many letters are there in a word of this length and who counts them all?  nobody does it any more"
ROWS = [
    (1, "the same text twice", "en"), (1, "the same text twice", "en"), (2, "the same text twice", "en"), (3, None, "de"), (4, "", None), (5, " \t\n ", "de"), (6, LONG, "en"),
    (7, WORD, None), (None, "a text without a number", "en"), (None, None, None), (8, f"before {ITEM} after", "de"), (8, f"before {ITEM} after", "de"), (9, "日本語 é ﬁ 😀 ́x", "de"), (10, "12345 !!! ???", None),
]
SCHEMA = "doc_id long, text string, lang string, score double, class_id long, pieces_ string, spans string, block int, part int, n string"


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 0.5, 1, "x", "y", 3, 4, "z") for r in rows], SCHEMA)


def benchmark(spark):
    return spark.createDataFrame([(1, ITEM, 5), (1, ITEM, 5), (2, None, 5), (3, "", 5), (None, ITEM + " indeed", 5)], "item_id long, text string, doc_id long")


OPERATORS = {
    "pieces": lambda s, d: encode_pieces(d, tokenizer_path("piece_bpe_32k.model")),
    "fingerprints": lambda s, d: fingerprints(d),
    "language": lambda s, d: identify_language(d),
    "repeats": lambda s, d: remove_repeats(d),
    "quality": lambda s, d: score_quality(d, s.createDataFrame([(1, 1, "x"), (1, 1, "x"), (7, 0, "x"), (None, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string")),
    "scores": lambda s, d: score_documents(d),
    "tokens": lambda s, d: count_tokens(d, tokenizer_path("word_bpe_49k.json")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_row_and_equal_rows_for_repeated_ones(spark, name):
    got = [r.asDict(recursive=True) for r in OPERATORS[name](spark, documents(spark)).collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, *_ in ROWS)
    # what follows a text is not the same for both rows of a doc_id, so fingerprints of edited texts may differ
    plain = [repr({k: v for k, v in r.items() if not k.startswith(("edited", "near"))}) for r in got if r["doc_id"] in (1, 8)]
    assert len(set(plain)) == 2
    assert OPERATORS[name](spark, documents(spark, [])).count() == 0
    only_nulls = OPERATORS[name](spark, documents(spark, [(None, None, None)])).collect()
    assert len(only_nulls) == 1 and only_nulls[0]["doc_id"] is None


def test_values_of_odd_rows(spark):
    df = documents(spark)
    tokens = {r["doc_id"]: r for r in count_tokens(df, tokenizer_path("word_bpe_49k.json")).collect()}
    assert (tokens[3]["n_bytes"], tokens[3]["n_tokens"], tokens[4]["n_tokens"], tokens[6]["over_limit"]) == (0, 0, 0, True) and tokens[6]["n_bytes"] == len(LONG)
    spoken = {r["doc_id"]: r for r in identify_language(df).collect()}
    assert [spoken[i]["lang_pred"] for i in (3, 4, 5, 10)] == ["und"] * 4 and all(0 <= r["score"] <= 1 for r in spoken.values())
    scores = {r["doc_id"]: r for r in score_documents(df).collect()}
    assert scores[3]["n_tokens"] == scores[4]["n_tokens"] == scores[5]["n_tokens"] == 1 and scores[6]["n_tokens"] == 600_001 and scores[3]["score"] == scores[5]["score"]
    prints = {r["doc_id"]: r for r in fingerprints(df).collect()}
    assert prints[1]["fingerprint"] == prints[2]["fingerprint"] and prints[3]["fingerprint"] == prints[4]["fingerprint"] == prints[5]["fingerprint"] and prints[6]["n_chars"] == len(LONG)


def test_classes_of_odd_rows(spark):
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(documents(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10}


def test_leaks_of_odd_rows(spark):
    found = leaks(documents(spark), benchmark(spark)).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in found) == [(8, 0), (8, 0), (8, 1), (8, 1)]
    clean = drop_leaked(documents(spark), benchmark(spark))
    assert clean.columns == documents(spark).columns and clean.count() == len(ROWS) - 2


def test_the_largest_id_is_not_a_missing_one(spark):
    rows = [(2**63 - 1, "the last of all"), (None, "without a number"), (0, "The  last of all"), (-(2**63), "the first"), (2**63 - 2, "WITHOUT a number")]
    got = {r["doc_id"]: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    order = [*sorted(i for i in texts if i is not None), None]
    assert set(got) == set(order)
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        assert got[i]["n_chars"] == len(texts[i]) and got[i]["edited_sha256"] == hashlib.sha256(edited(texts[i], texts[after]).encode()).hexdigest()
    assert got[2**63 - 1]["fingerprint"] == got[0]["fingerprint"] and got[None]["fingerprint"] == got[2**63 - 2]["fingerprint"]


def test_clashes_among_rows_without_id(spark):
    rows = [(None, "aa"), (None, "bb"), (1, "aa"), (2, "cc")]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), hashing=lambda form: b"one").collect()
    assert len(got) == 4 and len({r["fingerprint"] for r in got}) == 3
