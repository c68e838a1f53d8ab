"""Language and quality predictions against plain versions that hold everything in dictionaries and lists."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import zstandard

from uvsieve.llm.langid import identify_language
from uvsieve.llm.quality import score_quality, train, training_rows

M32 = 2**32 - 1


def plain_grams(text):
    """Buckets of the 3- and 4-byte grams at each byte, blanks beyond the end."""
    folded = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()] + [32] * 4
    out = []
    for a, b, c, d in zip(folded, folded[1:], folded[2:], folded[3:-1]):
        three = a << 16 | b << 8 | c
        four = (three * 0x01000193 & M32) ^ (d * 0x9E3779B1 & M32)
        out += [(three * 0x9E3779B1 & M32) >> 16, (four * 0x85EBCA6B & M32) >> 16]
    return out


def plain_languages(rows):
    """(lang_pred, score) of every text, in loops: counts, a classifier for each way to part the languages in two, weighted loss."""
    learned = [(t, lang) for i, t, lang in rows if t is not None and lang is not None and i is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    languages = sorted({lang for _, lang in learned})
    counts = {lang: collections.Counter() for lang in languages}
    for t, lang in learned:
        counts[lang].update(plain_grams(t))
    total = {lang: counts[lang].total() + 0.1 * 65_536 for lang in languages}
    chance = lambda lang, g: (counts[lang][g] + 0.1) / total[lang]
    splits = [(1, *signs) for signs in itertools.product((-1, 1), repeat=len(languages) - 1) if -1 in signs]

    def margin(grams, split):
        seen, sum_ = {}, 0.0
        for g in grams:
            if g not in seen:
                side = {s: [chance(lang, g) for lang, x in zip(languages, split, strict=True) if x == s] for s in (1, -1)}
                seen[g] = math.log(sum(side[1]) / len(side[1])) - math.log(sum(side[-1]) / len(side[-1]))
            sum_ += seen[g]
        return sum_ / math.sqrt(max(len(grams) / 2, 1))

    trained = [([margin(plain_grams(t), s) for s in splits], languages.index(lang)) for t, lang in learned]
    weights = []
    for b, split in enumerate(splits):
        # a margin of 0 (an empty text) is right for neither side
        right = sum(m[b] * split[y] > 0 for m, y in trained) / len(trained)
        weights.append(max(math.log((right + 1e-3) / (1 - right + 1e-3)), 0.05))
    weights = [w / sum(weights) for w in weights]
    losses = lambda m: [sum(w * math.log1p(math.exp(-x * s[k])) if x * s[k] > -500 else w * -x * s[k] for w, x, s in zip(weights, m, splits, strict=True)) for k in range(len(languages))]

    def surprise(sharpness):
        out = 0.0
        for m, y in trained:
            loss = [x * sharpness for x in losses(m)]
            out += loss[y] + math.log(sum(math.exp(-x) for x in loss))
        return out / len(trained)

    sharpness = min((0.5, 1.0, 2.0, 4.0, 8.0), key=surprise)
    out = []
    for _, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        loss = losses([margin(plain_grams(t), s) for s in splits])
        belief = [math.exp(-(x - min(loss)) * sharpness) for x in loss]
        out.append((languages[belief.index(max(belief))], max(belief) / sum(belief)))
    return out


def test_languages_are_the_plain_models(spark):
    rng = random.Random(9)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop", "dd": "éßмнабef"}
    rows = []
    for k in range(120):
        lang = rng.choice(sorted(letters))
        text = " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7))) for _ in range(rng.choice((1, 2, 30))))
        rows.append((k, text, lang if rng.random() < 0.9 else None))
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "12 !", "cc"), (None, "abc ABC", "dd"), (503, "ab", None), (503, "ab", None)]
    got = {}
    for r in identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    want = {}
    for (i, *_), found in zip(rows, plain_languages(rows), strict=True):
        want.setdefault(i, []).append(found)
    assert set(got) == set(want)
    for i in want:
        assert [x for x, _ in got[i]] == [x for x, _ in want[i]]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], atol=2e-4)  # weights are kept in 32 bits


def test_quality_scores_are_the_curve_over_sizes_of_blocks(spark):
    rng = random.Random(4)
    good, bad = [f"river{k} stone" for k in range(90)], [f"buy{k} now" for k in range(90)]
    rows = [(k, " ".join(rng.choice(good if k % 2 else bad) for _ in range(rng.choice((1, 20, 600))))) for k in range(200)]
    rows += [(900, None), (901, ""), (902, "é" * 3_000), (None, "river1 stone"), (3, rows[3][1])]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    model = train(training_rows(documents, labels, per_class=1_500, longest=32_768, folds=5, held_fold=0))
    kept = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 0}

    def size(raw, content):
        squeeze = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False, write_checksum=False)
        return sum(len(squeeze.compress(raw[at : at + model.block])) for at in range(0, len(raw), model.block))

    def score(text):
        raw = (text or "").encode()
        g, b, n = size(raw, model.good), size(raw, model.bad), max(len(raw), 1)
        d, r, s = max(min((b - g) / n, 1), -1), min((g + b) / (2 * n), 1), 1 / math.sqrt(n)
        z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], (d, r, d * d, r * r, d * r, s, d * s), strict=True))
        return model.doubt + (1 - 2 * model.doubt) / (1 + math.exp(-max(min(z, 30), -30)))

    got = score_quality(documents, labels).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    texts = dict(rows)
    for r in got:
        assert abs(r["score"] - score(texts[r["doc_id"]])) < 1e-6 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (r["doc_id"] is not None and r["doc_id"] not in kept)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 200 and len(texts[r["doc_id"]]) > 100]
    assert len(held) > 10 and all(r["predicted"] == r["doc_id"] % 2 for r in held)
