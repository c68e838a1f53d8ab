"""Whether a text holds an item depends on that item alone."""

import random

from uvsieve.llm.decontaminate import drop_leaked, leaks

DRAW = random.Random(12)
VOCABULARY = ["".join(DRAW.choices("abcdefghijklmnop", k=DRAW.randint(3, 9))) for _ in range(3000)]


def prose(n):
    return DRAW.choices(VOCABULARY, k=n)


def test_an_unrelated_long_item_changes_nothing(spark):
    item = prose(30)
    runs = [item[k : k + 5] for k in range(26)]
    scattered = [w for r in runs for w in [*prose(60), *r]]
    spread = [w for k in range(0, 30, 6) for w in [*item[k : k + 6], *prose(1)]]  # few runs are whole
    loose = [*item[:14], *prose(10), *item[14:]]  # 22 of 26 runs within 40 words
    far = [*item[:14], *prose(40), *item[14:]]  # as many within 70
    texts = {1: prose(200) + item + prose(300), 2: scattered, 3: spread, 4: prose(500) + loose, 5: far, 6: prose(3000), 7: item}
    documents = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    one = [(1, " ".join(item))]
    more = one + [(2, " ".join(prose(3000))), (3, " ".join(prose(400))), (4, " ".join(prose(12)))]
    alone, among = ({(r["doc_id"], r["item_id"], r["overlap"], r["question_overlap"], r["answer_overlap"]) for r in leaks(documents, spark.createDataFrame(items, "item_id long, text string")).collect()} for items in (one, more))
    assert alone == among and {(d, i) for d, i, *_ in alone} == {(1, 1), (4, 1), (7, 1)}
    assert {r["doc_id"] for r in drop_leaked(documents, spark.createDataFrame(more, "item_id long, text string")).collect()} == {2, 3, 5, 6}


def test_a_window_lies_whole_in_a_passage(spark):
    """Wherever the item stands, against a plain search of every window."""
    items = {1: prose(20), 2: prose(90), 3: prose(300)}
    texts = {}
    for k in range(60):
        own = items[k % 3 + 1]
        cut = DRAW.randint(1, len(own) - 1)
        texts[k] = prose(DRAW.randint(0, 700)) + own[:cut] + prose(DRAW.randint(0, len(own))) + own[cut:] + prose(DRAW.randint(0, 700))
    documents = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"], round(r["overlap"], 9)) for r in leaks(documents, spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string")).collect()}
    want = set()
    for d, text in texts.items():
        runs = [tuple(text[k : k + 5]) for k in range(len(text) - 4)]
        for i, item in items.items():
            own = [tuple(item[k : k + 5]) for k in range(len(item) - 4)]
            size, cut = max(32, -(-len(item) * 3 // 2)), -(-len(item) * 2 // 3)
            places = [k for k, r in enumerate(runs) if r in set(own)]
            best = 0.0
            for a in places:
                here = set(runs[a : a + size - 4])
                held = [r in here for r in own]
                asked = [k + 5 <= cut for k in range(len(own))]
                overlap = sum(held) / len(own)
                parts = [[h for h, q in zip(held, asked, strict=True) if q == side] for side in (True, False)]
                if overlap >= 0.8 and all(sum(p) / len(p) >= 0.5 for p in parts):
                    best = max(best, overlap)
            if best:
                want.add((d, i, round(best, 9)))
    assert found == want and 20 < len(want) < 60
