"""The pipeline against brute force, stage by stage, and as a whole."""

import os

import pytest

import corpus_pipeline
from tests.llm.test_corpus_operators import alike, held, multiset
from uvsieve.llm.quality import score_quality

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    good = {r["doc_id"] for r in score_quality(docs, labels).where("predicted = 1").collect()}
    rows = {r["doc_id"]: r.asDict() for r in docs.collect() if r["doc_id"] in good}
    # near-duplicates: the least of each class stays
    bags = {i: multiset(r["text"]) for i, r in rows.items()}
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(rows)
    for k, i in enumerate(ordered):
        for j in ordered[k + 1 :]:
            if find(i) != find(j) and alike(bags[i], bags[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    rows = {i: r for i, r in rows.items() if find(i) == i}
    # windows that also start earlier are cut, as judged on what is left now
    seen = set()
    for i in sorted(rows):
        raw = rows[i]["text"].encode()
        cover = bytearray(len(raw))
        for k in range(len(raw) - 99):
            window = raw[k : k + 100]
            if window in seen:
                cover[k : k + 100] = b"\1" * 100
            seen.add(window)
        rows[i]["text"] = bytes(x for x, c in zip(raw, cover, strict=True) if not c).decode(errors="ignore")
        rows[i]["n_chars"] = len(rows[i]["text"])
    items = [held(r["text"]) for r in bench.collect()]
    rows = {i: r for i, r in rows.items() if not any(s and len(s & held(r["text"])) >= 0.8 * len(s) for s in items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == set(rows)
    for i, r in rows.items():
        assert {k: got[i][k] for k in r} == r and got[i]["lossless"] and got[i]["n_pieces"] == len(got[i]["pieces"])


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "x y z " * 40, "k", 7), (2, None, None, None), (None, "a b", "m", 1)], "doc_id long, text string, extra string, n_chars int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.columns[:4] == docs.columns and last.count() == 3


def test_near_duplicate_stage_with_repeated_rows_and_without_ids(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(5, long, "a"), (5, long, "a"), (5, "another text of the same number", "b"), (3, long + " more", "c"), (None, long, "d"), (None, "one text with no number", "e"), (None, "one text with no number", "e"), (9, None, "f"), (10, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _extra string")
    got = sorted((r["doc_id"] or -1, r["_extra"]) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, FOLDER).collect())
    # 3 stands for the near copies (of doc_id 5 all rows go with the text that is one), one row for the repeated text without doc_id, 9 for the empty ones
    assert got == [(-1, "e"), (3, "c"), (9, "f")]
