"""Main texts against a plain version that holds all pages, runs of copies and mates in lists."""

import os.path
import random
from collections import Counter
from urllib.parse import urlsplit

import pytest

from uvsieve.llm import pages
from uvsieve.llm.pages import lines_of, main_texts

SCHEMA = "page_id long, url string, html string, text string"


def longest(a, b):
    """Places in a of a longest common subsequence, first ones first."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain(rows):
    found = []
    for page_id, url, html in rows:
        lines = lines_of(html or "")
        kind = "+" if any(k == "+" for k, _ in lines) else " "
        parts = urlsplit(url or "")
        found.append((parts.netloc.removeprefix("www."), parts.path.rstrip("/"), page_id, kind, lines))
    found.sort(key=lambda f: f[:3])
    runs = []
    for f in found:
        own = [Counter()]
        for k, t in f[4]:
            own[0][t] += len(t) * (k == f[3])
        size = own[0].total()
        if runs and runs[-1][-1][0][0] == f[0]:
            last, other = runs[-1][-1][1], runs[-1][-1][1].total()
            both = sum(min(own[0][t], last[t]) for t in own[0])
            if min(size, other) > 0 and both >= 0.9 * max(size, other):
                runs[-1].append((f, own[0]))
                continue
        runs.append([(f, own[0])])
    out = {}
    for k, run in enumerate(runs):
        before = runs[k - 1][-1][0] if k and runs[k - 1][-1][0][0] == run[0][0][0] else None
        after = runs[k + 1][0][0] if k + 1 < len(runs) and runs[k + 1][0][0][0] == run[0][0][0] else None
        for (_, path, page_id, kind, lines), _ in run:
            own = [t for _, t in lines]
            shared = [(len(os.path.commonprefix([path, m[1]])), longest(own, [t for _, t in m[4]])) for m in (before, after) if m]
            gone = set()
            if shared:
                gone = set.intersection(*(s for _, s in shared)) if kind == "+" else max(shared, key=lambda s: s[0])[1]
            out[page_id] = "\n".join(t for i, (k, t) in enumerate(lines) if k == kind and i not in gone)
    return out


def site(rng):
    """Sites of one, two and many pages, with articles and without, notices in the article, copies next to each other and near copies."""
    rows, k = [], 0
    story = lambda: " ".join(f"s{rng.randrange(10**6)}" for _ in range(rng.randint(1, 30)))
    for host in ("www.a.example", "b.example", "c.example", "d.example:80", "e.example"):
        n, notice, menu = rng.choice([1, 2, 3, 12]), f"We use cookies on {host} to make it better.", [f"{host} menu {m}" for m in range(rng.randint(0, 6))]
        for page in range(n):
            wrap = rng.choice(["div", "article", "main"])
            lines = [story() for _ in range(rng.randint(0, 4))]
            body = "".join(f"<p>{m}</p>" for m in menu) + f"<{wrap}><p>{notice}</p>" + "".join(f"<p>{x}</p>" for x in lines) + f"</{wrap}><div class='comments'>{story()}</div>"
            for copy in range(rng.choice([1, 1, 1, 2, 9])):
                rows.append((k, f"https://{host}/{page % 3}/{page:03}/{copy}", body + "<footer>x</footer>" * (copy % 2)))
                k += 1
    return rows


@pytest.mark.parametrize("partitions", ["1", "8", "40"])
def test_main_texts_brute_force(spark, partitions, monkeypatch):
    monkeypatch.setattr(pages, "HELD_BYTES", 200)
    rows = [r for seed in range(3) for r in site(random.Random(seed))]
    rows = [(k, u.replace(".example", f"{k // 60}.example") if u else u, h) for k, (_, u, h) in enumerate(rows)]
    rng = random.Random(1)
    rng.shuffle(rows)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = main_texts(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = plain([(i, u.replace(":80", ""), h) for i, u, h in rows])
    assert len(got) == len(rows)
    assert {r["page_id"]: r["text"] for r in got} == want
    assert any(f"cookies on" in h and "cookies" not in want[i] for i, _, h in rows)


def test_menus_longer_than_the_story_and_notices_go(spark):
    menu = "".join(f"<div>Menu entry number {k} of this site</div>" for k in range(10))
    two = [(k, f"http://two.example/{k}", f"<body>{menu}<p>Story number {k} of {k * 77}, told at some length for a test.</p></body>") for k in range(2)]
    notes = "<p>We use cookies to make this site better for all our readers.</p><p>Subscribe to our weekly newsletter today and never miss a story.</p>"
    main = [(10 + k, f"http://main.example/{k}", f"<main>{notes}<p>Words {k} of a story.</p></main>") for k in range(3)]
    got = {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame([(*r, "x") for r in two + main], SCHEMA)).collect()}
    assert got == {0: "Story number 0 of 0, told at some length for a test.", 1: "Story number 1 of 77, told at some length for a test.", **{10 + k: f"Words {k} of a story." for k in range(3)}}


def test_odd_pages(spark):
    long = "<article>" + "<p>" + "word " * 900_000 + "</p></article>"
    rows = [(1, "http://x.example/1", long), (2, None, None), (3, "", ""), (None, "::", "<p>alone</p>"), (4, "http://y.example/", "<p>same</p>"), (4, "http://y.example/", "<p>same</p>")]
    got = main_texts(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 5), (1, 4_499_999), (2, 0), (3, 0), (4, 4), (4, 4)]
    assert main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def article_of(page):
    return "\n".join(t for kind, t in lines_of(page) if kind == pages.INSIDE)


def test_blocks_about_something_else_stay():
    kept = ["class='share-price'", "class='comments-section-of-law'", "class='promo-code'", "class='tags-table'", "id='related-work'", "class='sharePrice'", "class='notice-period lead'", "class='menu-of-the-day'", "id=ad-hoc-networks"]
    gone = ["class='ad'", "class='ad-300x250'", "class='x site-nav'", "class='comment-list'", "id='comments'", "class='relatedPosts'", "class='share-buttons'", "class='cookie-banner'", "class='newsletter-signup-form'", "class='widget-area-2'", "class='social-media-links'", "class='post-comments'", "id=sidebar", "hidden", "style='display: none'"]
    for attribute in kept:
        assert article_of(f"<article><p>one</p><div {attribute}>two</div><p>three</p></article>") == "one\ntwo\nthree", attribute
    for attribute in gone:
        assert article_of(f"<article><p>one</p><div {attribute}>two</div><p>three</p></article>") == "one\nthree", attribute
    assert article_of("<article><h2 id='comments'>Comments</h2><p>on a verdict</p></article>") == "Comments\non a verdict"


def test_the_longest_article_is_the_article():
    teasers = "<article><h3>Elsewhere</h3><p>short</p></article>" * 3
    story = "<article><p>The story itself, which is longer.</p><article class='comment'>me too</article><article>inner</article></article>"
    for page in (teasers + story, story + teasers, f"<main><h1>Title</h1>{story}{teasers}</main>"):
        assert article_of(page).removeprefix("Title\n") == "The story itself, which is longer.\ninner"
    assert article_of(f"<main><h1>Title</h1>{story}{teasers}</main>").startswith("Title\n")
    assert article_of("<article>one</article><article>two</article>") == "one"
    assert article_of("<article></article><article></article>") == ""


def planted(rng):
    """A page with an article whose blocks are known, classes of all sorts in it and around it."""
    words = lambda: " ".join(rng.choice(("stone", "river", "price", "share", "tag", "menu", "notice", "law")) + str(rng.randrange(10**5)) for _ in range(rng.randint(3, 25)))
    names, ends = ("price", "law", "history", "value", "table", "work"), ("", "-list", "-box", "-area-2", "Wrapper")
    html, truth = [], []
    for _ in range(rng.randint(3, 15)):
        text = words()
        if rng.random() < 0.5:
            truth.append(text)
            html.append(rng.choice([f"<p>{text}</p>", f"<div class='{rng.choice(('share', 'comments', 'tags', 'promo'))}-{rng.choice(names)}'>{text}</div>", f"<section><h2 id='related'>{text}</h2></section>"]))
        else:
            html.append(f"<div class='{rng.choice(('', 'site-', 'post-'))}{rng.choice(('share', 'comments', 'tags', 'promo', 'ad', 'cookie'))}{rng.choice(ends)}'>{text}</div>")
    around = f"<nav>{words()}</nav><div class='sidebar'>{words()}</div>"
    return f"<html><body>{around}<article>{''.join(html)}</article><footer>{words()}</footer></body></html>", "\n".join(truth)


def test_planted_blocks(spark):
    rng = random.Random(5)
    sites = [planted(rng) for _ in range(200)]
    got = main_texts(spark.createDataFrame([(k, f"http://h{k % 7}.example/{k}", html, "x") for k, (html, _) in enumerate(sites)], SCHEMA)).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: truth for k, (_, truth) in enumerate(sites)}
