"""Scores against a plain model of three orders; they don't depend on how words are dealt into blocks, shards and parts."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard

from uvsieve.llm import eliasfano, lmscore
from uvsieve.llm.lmscore import narrow, score_documents, widened

SCHEMA = "doc_id long, text string, score string"


def corpus(n=300, seed=11):
    """Word frequencies are steep: the commonest word is cut into many parts when there are many shards."""
    rng = random.Random(seed)
    words = lambda k: " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(k))
    rows = [(k, words(rng.choice([0, 1, 2, 60]))) for k in range(n)]
    return rows + [(n + k, rows[rng.randrange(n)][1]) for k in range(40)] + [(9000, None), (None, words(30))]


def scored(spark, rows, **how):
    return {(r["doc_id"], r["n_tokens"]): r for r in score_documents(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), **how).collect()}


def discounted(counts, totals):
    """By context's power of two: what goes off counts of 1, 2 and more."""
    seen = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (*context, _), c in counts.items():
        if c <= 4:
            seen[totals[tuple(context)].bit_length() - 1][c - 1] += 1
    out = {}
    for group, n in seen.items():
        y = n[0] / max(n[0] + 2 * n[1], 1)
        off = [k - (k + 1) * y * n[k] / max(n[k - 1], 1) for k in (1, 2, 3)] if sum(n) >= 50 else [0.75] * 3
        out[group] = [min(max(x, 0.02), top) for x, top in zip(off, (0.98, 1.9, 2.9), strict=True)]
    return out


def plain_scores(rows):
    tokens = [(i, [w.lower() for w in (t or "").split()] + ["</s>"]) for i, t in rows]
    counts = [collections.Counter() for _ in range(3)]
    for i, ts in tokens:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            counts[0].update((w,) for w in ts)
            counts[1].update(zip(["</s>", *ts], ts))
            counts[2].update(zip(["</s>", *ts], ts, ts[1:]))
    n, v = sum(counts[0].values()), len(counts[0])
    follows = [collections.defaultdict(list), collections.defaultdict(list)]
    for k in (0, 1):
        for (*context, _), c in counts[k + 1].items():
            follows[k][tuple(context)].append(c)
    offs = [discounted(counts[k + 1], counts[k]) for k in (0, 1)]

    def p(context, word):
        if not context:
            return (counts[0][word,] + 0.5) / (n + 0.5 * (v + 1))
        k = len(context)
        total, lower = counts[k - 1][context], p(context[1:], word)
        if not total:
            return lower
        off = offs[k - 1].get(total.bit_length() - 1, [0.75] * 3)
        c = counts[k][*context, word]
        share = (c - off[min(c, 3) - 1]) / total if c else 0
        return share + sum(off[min(x, 3) - 1] for x in follows[k - 1][context]) / total * lower

    out = {}
    for i, ts in tokens:
        contexts = [("</s>",), *zip(["</s>", *ts], ts)]
        out[i, len(ts)] = sum(math.log10(p(c, w)) for c, w in zip(contexts, ts))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_scores_are_the_plain_models(spark, block_bytes):
    rows = corpus()
    got, want = scored(spark, rows, block_bytes=block_bytes), plain_scores(rows)
    assert set(got) == set(want)
    assert all(got[k]["score"] == pytest.approx(want[k], rel=1e-3, abs=2e-3) for k in want)  # shares are quantised to 1/2048 of a halving


def test_blocks_shards_and_parts_change_nothing(spark):
    rows, was = corpus(), spark.conf.get("spark.sql.shuffle.partitions")
    one = scored(spark, rows)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        many = scored(spark, rows, block_bytes=500)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert all(many[k]["score"] == pytest.approx(one[k]["score"], rel=1e-9) for k in one)


def test_a_second_copy_scores_higher(spark):
    """A text that the training rows hold word for word scores far above a shuffled one."""
    rng = random.Random(3)
    base = [" ".join(f"v{rng.randrange(200)}" for _ in range(50)) for _ in range(60)]
    shuffled = [" ".join(rng.sample(t.split(), 50)) for t in base]
    rows = list(enumerate(base)) + [(1000 + k, t) for k, t in enumerate(base + shuffled)]
    held = {i for i, _ in rows if i >= 1000 and zlib.crc32(str(i).encode()) % 5 == 1}
    got = {i: r["score"] for (i, _), r in scored(spark, rows).items()}
    copies = [got[i] for i in held if i < 1060 and zlib.crc32(str(i - 1000).encode()) % 5 != 1]  # of a training row
    others = [got[i] for i in held if i >= 1060]
    assert copies and others and min(copies) > max(others)


def test_a_long_text(spark):
    text = " ".join(f"u{k % 50021}" for k in range(700_000))
    got = scored(spark, [(0, text), (2, "u1 u2 u3")])
    assert got[0, 700_001]["n_tokens"] == 700_001 and got[2, 4]["score"] > got[2, 4]["base_score"]


def test_counts_beyond_32_bits():
    counts = np.array([0, 1, 2**32 + 5, 2**45])
    assert widened(narrow(counts)).tolist() == counts.tolist()


def chain(rows, shards, frequent):
    """All steps of scoring in one process, each document a block of its own."""
    blocks = pa.RecordBatch.from_pydict({"block": [k for k, _ in enumerate(rows)], "doc_id": [i for i, _ in rows], "training": [k % 3 != 1 for k, _ in enumerate(rows)], "packed": [zstandard.compress(t.encode()) for _, t in rows]})
    asked = pa.Table.from_batches(lmscore._asking(shards, frequent)(iter([blocks]))).sort_by("shard").combine_chunks()
    survey = collections.Counter()
    for batch in lmscore._surveying(frequent)(iter(asked.to_batches())):
        for place, n in zip(batch["place"].to_pylist(), batch["n"].to_pylist(), strict=True):
            survey[place] += n
    text = ",".join(f"{k}:{n}" for k, n in survey.items())
    asked = asked.append_column("survey", pa.array([text] * asked.num_rows))
    answers = pa.Table.from_batches(lmscore._answering(frequent)(iter(asked.to_batches())))
    answers = answers.append_column("survey", pa.array([text] * answers.num_rows))
    out = []
    for k in range(len(rows)):
        own = pa.Table.from_batches([blocks]).filter(pc.equal(pc.field("block"), k))
        out += lmscore._scoring(frequent)(own, answers.filter(pc.equal(pc.field("block"), k))).to_pylist()
    return out


def test_more_contexts_than_places_beside_a_name(monkeypatch):
    rows = [(i, t) for i, t in corpus(80) if i is not None and t]
    plain = chain(rows, 3, {})
    for bits in (0, 3):
        monkeypatch.setattr(eliasfano, "PLACE_BITS", bits)
        assert chain(rows, 3, {}) == plain


def test_successors_of_two_frequent_words_have_long_names(monkeypatch):
    """With names cut to one bit, other pairs take unseen successors for seen ones; those of frequent words don't."""
    rows = [(k, f"a b x{k}") for k in range(60)]
    a, b = (int(w) for w in lmscore.tokens_of(np.frombuffer(b"a b", np.uint8), np.array([0, 3]))[0][:2])
    exact = chain(rows, 3, {})
    monkeypatch.setattr(lmscore, "COARSE", np.uint64(39))
    fine, cut = chain(rows, 3, {a: 1, b: 2}), chain(rows, 3, {})
    held = [k for k in range(60) if k % 3 == 1]
    assert all(fine[k]["score"] == pytest.approx(exact[k]["score"], rel=1e-6) for k in held)
    assert sum(cut[k]["score"] > exact[k]["score"] + 0.1 for k in held) > 15
