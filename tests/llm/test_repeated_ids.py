"""Near-duplicates among documents of which some have several texts, against a plain search of all pairs."""

import random
from collections import Counter

from uvsieve.llm.minhash import near_duplicates


def bag(text):
    w = text.lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def alike(a, b):
    both, either = sum((a & b).values()), sum((a | b).values())
    return both >= 0.8 * either - 1e-9


def test_a_document_of_two_texts_joins_what_is_like_either(spark):
    draw = random.Random(21)
    vocabulary = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(400)]
    bases = [draw.choices(vocabulary, k=120) for _ in range(12)]
    rows = [(1, " ".join(bases[0])), (2, " ".join(bases[0])), (2, " ".join(bases[1])), (3, " ".join([*bases[1], "more"])), (2, " ".join(bases[1])), (None, "no number"), (40, None), (40, "")]
    for k in range(60):
        text = list(draw.choice(bases[2:]))
        for _ in range(draw.choice([0, 1, 2, 8])):
            text[draw.randrange(len(text))] = draw.choice(vocabulary)
        rows.append((draw.randint(5, 35), " ".join(text)))
    found = near_duplicates(spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, class_id long")).collect()
    mine = [(i, bag(t or "")) for i, t in rows if i is not None]
    label = {i: i for i, _ in mine}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in mine:
        for j, b in mine:
            if i < j and alike(a, b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    assert {r["doc_id"]: r["class_id"] for r in found} == {i: root(i) for i in label}
    assert {r["doc_id"]: r["class_id"] for r in found}[3] == 1 and len({root(i) for i in label}) > 3
    assert {r["doc_id"]: r["text_id"] for r in found}[2] == 1
