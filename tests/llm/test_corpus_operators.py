"""Operators that hold documents against each other, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from uvsieve.llm import minhash, repeats
from uvsieve.llm.components import components
from uvsieve.llm.decontaminate import drop_leaked, leaks
from uvsieve.llm.digest import canonical, digest, fingerprints
from uvsieve.llm.eliasfano import Sequence, Store, quantised, restored
from uvsieve.llm.lmscore import score_documents
from uvsieve.llm.pages import common_lines, lines_of, main_texts
from uvsieve.llm.repeats import cut_repeats, remove_repeats

SCHEMA = "doc_id long, text string, class_id string, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# fingerprints


def test_fingerprints_brute_force(spark):
    rng = random.Random(3)
    rows = [(k * 3 - 20, rng.choice(["", "Ab  C", "ab c", "ﬁne\tÄ", "straße", "x" * 50, "y" * rng.randint(1, 99)])) for k in range(120)] + [(1000, None)]
    got = {r["doc_id"]: r for r in fingerprints(docs(spark, rows)).collect()}
    ordered = [(i, t or "") for i, t in sorted(rows)]
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        n = len(t) // 4
        changed = t[: len(t) - n] + following[:n]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == digest(canonical(t)).hex() and r["edited_fingerprint"] == digest(canonical(changed)).hex()
        assert r["near_edited"] == float(canonical(t) == canonical(changed)) and r["near_next"] == float(canonical(t) == canonical(following))


def test_fingerprints_of_few(spark):
    assert fingerprints(docs(spark, [])).count() == 0
    r = fingerprints(docs(spark, [(7, "abcdefgh")])).first()
    assert r["near_next"] == 1 and r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def coarse(form):
    return bytes([sum(form) % 5])


def test_fingerprints_where_digests_clash(spark):
    """With five digests in all, texts and edited texts of different canonical forms still have different fingerprints, and equal ones equal."""
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 9)))) for k in range(200)] + [(None, "ab"), (3, "ab")]
    got = fingerprints(docs(spark, rows), hashing=coarse).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 1
    found, ordered = {}, sorted(r for r in rows if r[0] is not None)
    byid = {r["doc_id"]: r for r in got}
    for (i, t), (_, following) in zip(ordered, ordered[1:], strict=False):
        if i not in (2, 3):  # two texts have the doc_id 3
            changed = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
            for form, name in ((canonical(t), "fingerprint"), (canonical(changed), "edited_fingerprint")):
                found.setdefault(byid[i][name], set()).add(form)
    assert all(len(f) == 1 for f in found.values()) and len(set.union(*found.values())) == len(found)


# near-duplicates


def multiset(text, size=5):
    w = text.lower().split()
    return collections.Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else collections.Counter()


def alike(a, b):
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both >= 0.8 * total - 1e-9 if total else not a and not b


def near_rows():
    rng, rows = random.Random(5), []
    for k in range(40):
        base = words(rng, rng.choice([3, 8, 60, 200]))
        rows.append(base)
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 8])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append(copy)
    texts = [" ".join(r) for r in rows] + ["", None, "  ", "A b c d e f g", "a  B c d e f g", " ".join(["la"] * 100), " ".join(["la"] * 110), " ".join(["la"] * 30)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("bucket,block", [(4096, 6000), (4, 3)])
def test_near_duplicates_brute_force(spark, monkeypatch, bucket, block):
    rows = near_rows()
    bags = {i: multiset(t or "") for i, t in rows}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in bags:
        for j in bags:
            if i < j and find(i) != find(j) and alike(bags[i], bags[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    monkeypatch.setattr(minhash.coarse_links, "__defaults__", (bucket, minhash.COARSE))
    monkeypatch.setattr(minhash.verified_links, "__defaults__", (block,))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(spark, [*rows, rows[0]])).collect()}
    assert got == {i: find(i) for i in bags}
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(0, 6, 300), rng.integers(0, 6, 300)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    ka, kb = np.flatnonzero(a), np.flatnonzero(b)
    s = minhash.signatures(np.r_[h[ka], h[kb]], np.r_[a[ka], b[kb]], np.r_[np.zeros(len(ka), int), np.ones(len(kb), int)], 2, slots=4096)
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {x: find(x) for x in parent}
    assert all(got.get(x, x) == c for x, c in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# repeated passages


def uncovered(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for k in range(len(raw) - 99):
            window = raw[k : k + 100]
            if window in seen:
                cover[k : k + 100] = b"\1" * 100
            seen.add(window)
        rest = bytes(x for x, c in zip(raw, cover, strict=True) if not c)
        out[i] = (len(raw), len(raw) - len(rest), sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover)), hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("share", [repeats.SHARE, 0.0])
def test_repeats_brute_force(spark, share):
    rng = random.Random(1)
    parts = ["ab", "abc", "é", "xyz ", "q" * 30, "日本" * 20]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 40, 200])))) for i in range(50)]
    rows += [(100, "z" * 1000), (101, "z" * 300), (102, None), (103, ""), (104, "ab" * 200), (105, "x" * 99), (106, "x" * 100), (107, "x" * 100), (-5, "z" * 150)]
    df = docs(spark, [*rows, rows[3]])
    want = uncovered(rows)
    got = [r for r in remove_repeats(df, share=share).collect()]
    assert len(got) == len(rows) + 1
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)
    left = cut_repeats(df, share=share)
    assert left.columns == df.columns and left.count() == len(rows) + 1 and left.where("doc_id = 102 and text is null").count() == 1
    assert remove_repeats(docs(spark, [])).count() == 0


def test_repeats_with_hot_parts(spark):
    """Frequent anchors with many different surroundings are cut until each part is one window."""
    rng = random.Random(2)
    core = "".join(rng.choice("abcdefgh") for _ in range(60))
    edge = lambda n: "".join(rng.choice("ab") for _ in range(n))
    rows = [(k, edge(rng.randint(0, 60)) + core + edge(rng.randint(0, 60))) for k in range(120)]
    rows += [(200 + k, rows[k % 40][1][rng.randint(0, 9) :]) for k in range(80)]
    want = uncovered(rows)
    for share in (0.0, 0.5):
        got = remove_repeats(docs(spark, rows), share=share).collect()
        assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]] for r in got) and sum(r["n_removed"] for r in got) > 1000


def test_repeats_of_odd_rows(spark):
    """One doc_id with two texts, rows without doc_id, and a text of several slices."""
    rows = [(1, "p" * 150), (1, "q" * 300), (None, "q" * 120), (None, "r" * 101), (None, None), (7, "z" * 30_000), (8, " ".join(f"{k * 7919 % 99991}" for k in range(500_000)))]
    got = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"]) for r in remove_repeats(docs(spark, rows)).collect()}
    assert got == {(1, 150): (149, 1), (1, 300): (299, 1), (None, 120): (120, 1), (None, 101): (100, 1), (None, 0): (0, 0), (7, 30_000): (29_999, 1), (8, len(rows[-1][1])): got[8, len(rows[-1][1])]}
    assert got[8, len(rows[-1][1])][0] > 400_000 * 5 - 10_000  # the numbers come round after 99,991
    assert cut_repeats(docs(spark, rows)).count() == len(rows)


# benchmark leaks


def held(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_leaks_brute_force(spark):
    rng = random.Random(4)
    items = [(k, " ".join(words(rng, rng.choice([1, 3, 12, 40, 120]), 300)) + ("?" if k % 3 else "") + " " + " ".join(words(rng, 9, 300))) for k in range(25)] + [(90, None), (91, "!!"), (92, "")]
    rows = []
    for k in range(80):
        t = words(rng, rng.choice([0, 20, 300]), 300)
        if k % 2:
            body = items[k % 25][1].split()
            body = body[: max(1, int(len(body) * rng.choice([0.5, 0.85, 1.0])))]
            at = rng.randrange(len(t) + 1)
            t[at:at] = [b.upper() + "," for b in body]
        rows.append((k, " ".join(t)))
    rows += [(200, None), (201, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["overlap"] for r in leaks(docs(spark, rows), bench, least_part=0.0).collect()}
    want = {}
    for i, t in rows:
        for j, q in items:
            s = held(q or "")
            if s and len(s & held(t or "")) >= 0.8 * len(s) - 1e-9:
                want[i, j] = len(s & held(t or "")) / len(s)
    assert set(got) == set(want) and len(want) > 10
    whole = sorted(leaks(docs(spark, rows), bench).collect())
    assert whole == sorted(leaks(docs(spark, rows), bench, index_bytes=500).collect())  # scores and all: statistics are of all items
    strict = {(r["doc_id"], r["item_id"]) for r in whole}
    assert strict <= set(want)
    clean = drop_leaked(docs(spark, rows), bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in strict}
    assert leaks(docs(spark, rows), bench.limit(0)).count() == 0 and drop_leaked(docs(spark, rows), bench.limit(0)).count() == len(rows)


# language-model scores


def test_sequences():
    rng = np.random.default_rng(2)
    for values in ([], [0], [5], np.sort(rng.integers(0, 2**62, 70_000)), np.sort(rng.integers(0, 50, 1000)), np.arange(100)):
        values = np.array(values, np.uint64)
        s = Sequence(values, Store())
        assert s.at(np.arange(len(values))).tolist() == values.tolist()
        keys = np.r_[values[::7], values[::11] + np.uint64(1), np.uint64(0)].astype(np.uint64)
        place, equal = s.successor(keys)
        assert equal.tolist() == np.isin(keys, values).tolist()
        assert place.tolist() == np.searchsorted(values, keys).tolist()
    p = np.array([1.0, 0.5, 1e-6, 0.0])
    assert (restored(quantised(p)) <= p).all() and np.allclose(restored(quantised(p)), p, rtol=1e-3)


def test_scores_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(words(rng, rng.choice([0, 5, 80]), 60)).replace("w1", "W1")) for k in range(150)] + [(500, None), (501, "A\x0bb\x1cc d")]
    got = {r["doc_id"]: r for r in score_documents(docs(spark, rows)).collect()}
    tokens = {i: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for i, t in rows}
    counts = collections.Counter(x for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for x in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ts), sum(counts[x] > 0 for x in ts), n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] <= 0
    small = {r["doc_id"]: r["score"] for r in score_documents(docs(spark, rows), block_bytes=300).collect()}
    assert all(small[i] == pytest.approx(got[i]["score"], rel=1e-9) for i in small)
    assert score_documents(docs(spark, [])).count() == 0


def test_probabilities_do_not_exceed_one(spark):
    rows = [(k, t) for k, t in enumerate(["a b", "a c", "b a", "a b c", "c"] * 4)]
    tests = [(1000 + k, f"{x} {y}") for k, (x, y) in enumerate((x, y) for x in "abcz" for y in "abcz")]
    p = {r["doc_id"]: 10 ** r["score"] for r in score_documents(docs(spark, rows + tests), folds=10**9, held_fold=-1).collect()}
    assert sum(p[i] for i, _ in tests) <= 1


# pages


def test_lines_of_page():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>x</p>";</script><style>p{}</style></head><body><header><p>Site</p></header><nav><ul><li>Home</li></ul></nav>
    <div class="cookie-notice">We use cookies</div><main><article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>
      three&nbsp;four<br>five<p>Six<ul><li>a</li><li>b</li></ul><form><p>Sign up</p></form><aside>Also</aside><div id="comments"><p>Nice!</p></div></article></main><footer>&copy; x</footer></body></html>"""
    assert [t for m, t in lines_of(page) if m == "-"] == ["T", "Site", "Home", "We use cookies", "Sign up", "Also", "Nice!", "© x"]
    assert [t for m, t in lines_of(page) if m == "+"] == ["Head & line", "One two three four five", "Six", "a", "b"]
    assert [t for _, t in lines_of("plain < text <b>bold</b> &lt;")] == ["plain < text bold <"]
    assert lines_of("") == [] and lines_of("<p>") == [] and [t for _, t in lines_of("<article><p>cut o")] == ["cut o"]


def test_common_lines_are_longest():
    rng = random.Random(8)
    for _ in range(60):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 12))] for _ in "ab")
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        got = common_lines(np.array(a), np.array(b))
        assert len(got) == table[-1, -1] and got == sorted(set(got))


def test_differencing_removes_what_pages_share(spark):
    page = lambda k: f"<body><p>Daily News Portal</p><p>Weather today Sports</p><h2>Story {k}</h2><p>Text of story number {k} is this long sentence about {k * 7}.</p><p>Terms of use apply.</p></body>"
    rows = [(k, f"https://a.example/news/{k}", page(k)) for k in range(6)] + [(50, "https://b.example/x", page(50)), (60, None, None), (61, "::", "<p>alone</p>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in main_texts(df).collect()}
    assert len(got) == len(rows)
    for k in range(6):
        assert got[k]["text"] == f"Story {k}\nText of story number {k} is this long sentence about {k * 7}."
    assert got[50]["text"].startswith("Daily News Portal") and got[60]["text"] == "" and got[60]["n_chars"] == 0 and got[61]["text"] == "alone"
    assert main_texts(df.limit(0)).count() == 0
