"""Main text of web pages by differencing with the pages of nearest URL.

A page's markup is cut into lines: one for each block of text, whatever element it stands in. Pages are put in order of
host and path; a page's mates are the page before and the page after it on its host, copies passed over, and the nearer is the one
whose path it shares the longer start with. The lines of a page and of each mate are aligned by their longest common subsequence, and what both
have is the site's, not the page's: lines shared with the nearer mate are deleted. In an article element it takes both mates (where there are two),
so that a passage that one neighbour quotes stays.

Elements speak only for lines that no alignment deletes, since a site may have texts that no two pages share: those in elements
that never hold main text (menus, forms, adverts by class or role, reader comments and so on) go too, and on a page with an article
or main element those outside of it. A class or id speaks by its end: `comment-list` and `site-nav` do, `share-price` and `comments-section-of-law` are
about something else. Of several article elements beside each other the one with most text (the first of equals) is the article, the others tell of other pages.

Pages that follow each other and are alike in 90 % of their main text, by length, are copies. A run of copies has the same mates: the last
page before it and the first after it.
"""

from __future__ import annotations

import html
import os.path
import pickle
import re
import tempfile
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|math|textarea|select|object|canvas|audio|video)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Element names, and words of class, id and role, that mark what isn't main text.
SKIPPED = frozenset("head title nav aside footer form button menu dialog label input option datalist fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
MARKED = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted related replies reply respond share sharing shares sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets".split())
#: Words that may stand behind a marking word, since they only tell of a place on the page.
PLACES = frozenset("area bar block body bottom box btn button buttons center container content footer form frame group header heading icon icons image inner item items label left link links list main media message module outer overlay panel placement post posts primary right row secondary section slot small text title to toggle top unit wrap wrapper zone".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar alertdialog form".split())
MAIN = frozenset(("article", "main"))
#: Kinds of lines: in an article or main element, outside of one, and in an element that never holds main text.
INSIDE, OUTSIDE, APART = "+", " ", "-"
#: The share of both pages' main text, by length, that makes them copies.
COPY = 0.9
#: Ranges of URLs for each shuffle partition, and URLs sampled to cut a range.
RANGES, SAMPLES = 4, 40
#: Bytes of markup for each shuffle partition, at most on average.
PART_BYTES = 32 << 20
#: Bytes of packed pages of a run of copies held in memory; the rest waits in a scratch file of the task.
HELD_BYTES = 32 << 20


def is_marking(token: str) -> bool:
    """Whether a class or id ends in a word that marks what isn't main text, words of place, numbers and single letters passed over."""
    for word in reversed(WORD.findall(token)):
        word = word.lower()
        if word in MARKED:
            return True
        if word not in PLACES and len(word) > 1 and not word.isdigit():
            return False
    return False


def _is_marked(element: str, rest: str) -> bool:
    if "=" not in rest and "hidden" not in rest:
        return False
    for name, a, b, c in ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name == "class" or (name == "id" and element not in HEADINGS):  # a heading's id is where links lead to
            if any(map(is_marking, value.split())):
                return True
        elif name == "role":
            if value.strip().lower() in ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, str]]:
    """The page's blocks of text in order, each with its kind. Raw elements (scripts, styles, drop-down lists and so on) have none."""
    out: list[tuple[str, str]] = []
    block: list[str] = []
    apart: list[str] = []
    inside, skipping, depth = 0, "", 0
    article, articles = 0, 0  # how deep in article elements, and the number of the outermost one
    of: list[int] = []  # the outermost article of each line, 0 if none
    at = 0

    def close(pieces: list[str], kind: str) -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append((kind, text))
                of.append(articles if article else 0)
            pieces.clear()

    def place() -> str:
        return INSIDE if inside else OUTSIDE

    for token in TOKEN.finditer(page):
        if token.start() > at:
            (apart if skipping else block).append(page[at : token.start()])
        at = token.end()
        name = token["name"]
        if not name:
            continue
        name, closing = name.lower(), bool(token["close"])
        if skipping:
            if name in BLOCKS or name in SKIPPED:
                close(apart, APART)
            elif name in VOID or name in ("td", "th"):
                apart.append(" ")
            if name == skipping:
                depth += -1 if closing else not token["rest"].endswith("/")
                if depth <= 0:
                    close(apart, APART)
                    skipping = ""
                continue
            # an article that begins, or whatever ends the body, ends an element that was never closed
            if not ((name in MAIN and not closing and not inside) or (closing and (name in ("body", "html") or (name in MAIN and inside)))):
                continue
            close(apart, APART)
            skipping = ""
        if closing:
            if name in BLOCKS:
                close(block, place())
                if name in MAIN and inside:
                    inside -= 1
                    article -= name == "article" and article > 0
            continue
        if name in VOID:
            if name == "hr":
                close(block, place())
            else:
                block.append(" ")
            continue
        skip = name in SKIPPED or (name == "header" and not inside) or ((name not in ("html", "body", "article", "main") or (name == "article" and article)) and _is_marked(name, token["rest"]))
        if name in BLOCKS or (skip and name not in ("label", "button")):
            close(block, place())
        if skip:
            if not token["rest"].endswith("/"):
                skipping, depth = name, 1
            continue
        if name in ("td", "th"):
            block.append(" ")
        if name in MAIN:
            inside += 1
            if name == "article":
                articles += not article
                article += 1
    if at < len(page):
        (apart if skipping else block).append(page[at:])
    close(apart, APART)
    close(block, place())
    if articles > 1:
        sizes = [0] * (articles + 1)
        for k, (kind, text) in zip(of, out, strict=True):
            sizes[k] += len(text) * (kind == INSIDE)
        own = max(range(1, articles + 1), key=lambda k: sizes[k])
        out = [(APART if k not in (0, own) else kind, text) for k, (kind, text) in zip(of, out, strict=True)]
    return out


def common_lines(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in ``a`` of a longest common subsequence of two sequences of line hashes."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    places: dict[int, list[int]] = {}
    for j in range(len(b) - end - 1, start - 1, -1):
        places.setdefault(int(b[j]), []).append(j)
    tails: list[int] = []
    chain: list[tuple | None] = []
    for i in range(start, len(a) - end):
        for j in places.get(int(a[i]), ()):
            k = bisect_left(tails, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chain.append(link)
            else:
                tails[k], chain[k] = j, link
    middle, link = [], chain[-1] if chain else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(start), *reversed(middle), *range(len(a) - end, len(a))]


def line_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


@dataclass
class Page:
    """A page as the stream of pages in order of URL holds it."""

    page_id: int | None
    url: str | None
    host: str
    path: str
    packed: bytes
    lines: list[tuple[str, str]] = field(init=False)
    hashes: np.ndarray = field(init=False)
    main: Counter = field(init=False)
    size: int = field(init=False)

    def __post_init__(self) -> None:
        content = zstandard.ZstdDecompressor().decompress(self.packed).decode() if self.packed else ""
        self.lines = [(x[0], x[1:]) for x in content.split("\n")] if content else []
        self.hashes = np.array([line_hash(t) for _, t in self.lines], np.int64)
        kind = INSIDE if any(k == INSIDE for k, _ in self.lines) else OUTSIDE
        self.main = Counter()
        for (k, t), h in zip(self.lines, self.hashes.tolist(), strict=True):
            if k == kind:
                self.main[h] += len(t)
        self.size = sum(self.main.values())

    def is_copy(self, other: Page) -> bool:
        low, high = sorted((self.size, other.size))
        return low > 0 and low >= COPY * high and (self.main & other.main).total() >= COPY * high

    def text(self, before: Page | None, after: Page | None) -> str:
        """The page's text without lines that its mates have too."""
        mates = [m for m in (before, after) if m is not None]
        shared = [set(common_lines(self.hashes, m.hashes)) for m in mates]
        near = max(range(len(mates)), key=lambda k: len(os.path.commonprefix([self.path, mates[k].path])), default=None)  # the earlier of equals
        site = set.intersection(*shared) if shared else set()
        kind, gone = (INSIDE, site) if any(k == INSIDE for k, _ in self.lines) else (OUTSIDE, shared[near] if mates else set())
        return "\n".join(t for i, (k, t) in enumerate(self.lines) if k == kind and i not in gone)


def _line_rows(bounds: list[tuple]):
    """Per page: the range its URL falls into, and its packed lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=9).compress
        for batch in batches:
            for rows, column in slices(batch, "html"):
                packed = [pack("\n".join(k + t for k, t in lines_of(p)).encode()) for p in column.to_pylist()]
                keys = zip(*(rows.column(c).to_pylist() for c in ("host", "path", "place")), strict=True)
                part = pa.array([bisect_right(bounds, k) for k in keys], pa.int32())
                yield pa.RecordBatch.from_arrays([part, *(rows.column(c) for c in ("host", "path", "place", "page_id", "url")), pa.array(packed, pa.binary())], ["part", "host", "path", "place", "page_id", "url", "packed"])

    return run


class Run:
    """Pages that follow each other and are copies. Not known: what stands before the first run of a range, and after the last."""

    def __init__(self, part: int, page: Page, before: Page | None, first: bool):
        self.part, self.before, self.after, self.first, self.last = part, before, None, first, False
        self.opening = self.closing = page
        self.rows, self.size, self.file = [], 0, None
        self.add(page)

    def add(self, page: Page) -> None:
        self.closing = page
        self.rows.append(_row(page))
        self.size += len(page.packed)
        if self.size > HELD_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.rows, self.file)
            self.rows, self.size = [], 0

    def pages(self) -> Iterator[tuple]:
        if self.file:
            self.file.seek(0)
            while True:
                try:
                    yield from pickle.load(self.file)
                except EOFError:
                    break
        yield from self.rows


def _row(page: Page | None) -> tuple:
    return (page.page_id, page.url, page.host, page.path, page.packed) if page else (None,) * 5


def _page(row: tuple) -> Page | None:
    return Page(*row) if row[4] is not None else None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """The runs of copies of each range, from pages in order."""
    run: Run | None = None
    for batch in batches:
        for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "page_id", "url", "host", "path", "packed")), strict=True):
            page = Page(*row)
            if run is None or run.part != part:
                if run is not None:
                    run.last = True
                    yield run
                run = Run(part, page, None, True)
            elif page.host == run.closing.host and page.is_copy(run.closing):
                run.add(page)
            else:
                same = page.host == run.closing.host
                run.after = page if same else None
                yield run
                run = Run(part, page, run.closing if same else None, False)
    if run is not None:
        run.last = True
        yield run


RESULT = "page_id long, url string, text string, n_chars long"
ROW = [(n, t) for n, t in zip(("page_id", "url", "host", "path", "packed"), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)]
NAMES = [*(n for n, _ in ROW), *(f"{m}_{n}" for m in ("before", "after") for n, _ in ROW)]
TYPES = [t for _, t in ROW] * 3
PAGES = ", ".join(f"{n} {'long' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for n, t in zip(NAMES, TYPES, strict=True))


def _result(out: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([len(x[2]) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _inner_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of all pages but those of each range's first and last run."""
    out, size = [], 0
    for run in _runs(batches):
        if run.first or run.last:
            continue
        for row in run.pages():
            out.append((row[0], row[1], Page(*row).text(run.before, run.after)))
            size += len(out[-1][2])
            if size > 4 << 20:
                yield _result(out)
                out, size = [], 0
    yield _result(out)


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of each range's first and last run, with the mates known so far (kind 0); and for a range's ends a row of kind 1, 2 or 3:
    first, last or only run, with its first page (a first run) or last page, and the mate on the other side."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), *(pa.array([r[3 + k] for r in rows], t) for k, t in enumerate(TYPES))], ["part", "kind", "edge", *NAMES])

    for run in _runs(batches):
        if not (run.first or run.last):
            continue
        edge, known = run.first + 2 * run.last, (*_row(run.before), *_row(run.after))
        if run.first:
            yield batch_of([(run.part, 1, edge, *_row(run.opening), *known)])
        if run.last:
            yield batch_of([(run.part, 2, edge, *_row(run.closing), *known)])
        out = []
        for row in run.pages():
            out.append((run.part, 0, edge, *row, *known))
            if len(out) == 500:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)


def _mates_of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range, in order, the mate before its first run and the mate after its last: found in the ranges on either side, or beyond them if these are copies throughout."""
    ends: dict[int, dict[int, tuple]] = {}
    for batch in batches:
        for part, kind, edge, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "edge", *NAMES)), strict=True):
            ends.setdefault(part, {})[kind] = (edge, _page(row[:5]), row[5:10], row[10:])
    parts = sorted(ends)
    found: dict[int, list] = {p: [None, None] for p in parts}
    for side, order in ((0, parts), (1, parts[::-1])):
        # what lies on this side of the range just passed: its outermost page, and the mate beyond the run that it belongs to
        outer, beyond = None, None
        for part in order:
            edge, near, *_ = ends[part][1 + side]
            if outer is not None and outer.host == near.host:
                found[part][side] = beyond if outer.is_copy(near) else outer
            edge, far, *known = ends[part][2 - side]
            outer = far
            beyond = found[part][side] if edge == 3 else _page(known[side])
    rows = [(p, *_row(b), *_row(a)) for p, (b, a) in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[1 + k] for r in rows], t) for k, t in enumerate(TYPES[5:]))], ["part", *(f"outer_{n}" for n in NAMES[5:])])


def _edge_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for edge, *row in zip(*(batch.column(c).to_pylist() for c in ("edge", *NAMES, *(f"outer_{n}" for n in NAMES[5:]))), strict=True):
            before, after = _page(row[15:20] if edge & 1 else row[5:10]), _page(row[20:25] if edge & 2 else row[10:15])
            out.append((row[0], row[1], Page(*row[:5]).text(before, after)))
        yield _result(out)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages(page_id, url, html)``.

    A null html is empty and has an empty text. Pages with null or unreadable URLs are mates of each other only. Rows that repeat are
    rows of their own, and copies. Pages of one URL follow each other in order of page_id (null first). Pages of any
    length are read whole; an empty table gives an empty one. Other columns are not read.

    Pages are dealt by ranges of URLs, cut by a sample of ``SAMPLES`` for each; in a range they stream past in order. Only the first and the last run of
    each range wait for the mates beyond it; the result doesn't depend on where the ranges are cut.
    """
    url = F.coalesce("url", F.lit(""))
    pattern = "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, pattern, 1)), "^(www\\.|m\\.)|:\\d+$", "")
    path = F.regexp_replace(F.regexp_extract(url, pattern, 2), "/+$", "")
    page_id = F.col("page_id").cast("long")
    placed = pages.select(page_id.alias("page_id"), "url", "html", host.alias("host"), path.alias("path"), F.coalesce(page_id, F.lit(-(2**63)).cast("long")).alias("place"))
    sizes = pages.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes")).first()
    n = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes["bytes"] // PART_BYTES))
    ranges = n * RANGES
    one_in = max(1, sizes["rows"] // (ranges * SAMPLES))
    key = ["host", "path", "place"]
    sample = sorted(tuple(r) for r in placed.select(*key).where(F.pmod(F.xxhash64(*key, F.lit(4)), F.lit(one_in)) == 0).collect())  # about SAMPLES for each range
    bounds = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []
    schema = "part int, host string, path string, place long, page_id long, url string, packed binary"
    ordered = placed.mapInArrow(_line_rows(bounds), schema).repartition(n, "part").sortWithinPartitions("part", *key, "packed")  # shuffled once, read by each branch
    edges = ordered.mapInArrow(_edge_rows, f"part int, kind int, edge int, {PAGES}")
    outer = ", ".join(f"outer_{c}" for c in PAGES.split(", ")[5:])
    mates = edges.where("kind > 0").repartition(1).mapInArrow(_mates_of_ranges, f"part int, {outer}")  # two rows for each range
    late = edges.where("kind = 0").join(mates, "part").mapInArrow(_edge_texts, RESULT)
    return ordered.mapInArrow(_inner_texts, RESULT).unionAll(late)
