"""Benchmark decontamination by a BM25 index of test items and block-max WAND.

The test items are indexed; every passage of every training text is a query. An item's weights
are divided by the least score that a passage holding enough of it must reach, so "above the
threshold" is a score of 1 for each item alike, and none that could pass verification is missed.

For a passage the terms are taken in order of their largest weight. Those that come first and
cannot reach 1 together are not essential: a block of items which no other term of the passage touches
is skipped (the pivot of WAND). For touched blocks the blocks' own largest weights are summed, of the essential terms first and then of all; only
where that bound reaches 1 are the block's postings read and its items scored. Retrieved items are verified:
enough of their five-word runs, in the question and in the answer part, must stand within a window of the passage that is half as long again as the item itself. Any such window lies whole
in one passage, so whether an item is held doesn't depend on other items. Items of like length share an index, and with it the length of passages.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ragged, slices, texts, utf8
from .words import PUNCTUATED, shingles, span_hashes, spans

K1, B = 1.2, 0.75
SIZE = 5
BLOCK = 8
#: Words of the window that an item is verified in: so many times its own, and at least so many.
WINDOW, LEAST_WINDOW = 1.5, 32
#: Items up to so many bytes share indexes, and each of the next classes goes four times as far.
CLASS_BYTES = 1024
#: Bytes of test items that one index holds; more items make more indexes. So many of them are broadcast together.
INDEX_BYTES = 8 << 20
AT_A_TIME = 4
SLACK = 1e-6
#: Bounds of passages and blocks that are held at a time.
CELLS = 1 << 20


@dataclass(frozen=True)
class Index:
    item_ids: list[int]
    hashes: np.ndarray  # of the terms, sorted
    opening: np.ndarray  # where the hashes of each leading 16 bits begin
    number: np.ndarray  # their terms' numbers: terms are numbered by their largest weight
    most: np.ndarray  # largest weight of each term, rising
    block_from: np.ndarray  # per term: where its blocks begin in the next two
    blocks: np.ndarray
    block_most: np.ndarray
    post_from: np.ndarray  # per term and block: where its postings begin in the next two
    post_item: np.ndarray
    post_weight: np.ndarray
    runs: list[np.ndarray]  # five-word runs of each item
    question: list[np.ndarray]  # which of them lie in the question
    window: np.ndarray  # of each item, in words
    stride: int  # of passages: the longest window


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, ends = utf8(pc.utf8_lower(column))
    starts, stops, owner = spans(data, ends, PUNCTUATED)
    return span_hashes(data, starts, stops), owner


def question_length(text: str, n_words: int) -> int:
    """Words of the question part: up to the last question mark that has words on both sides, else two thirds."""
    before = text.rpartition("?")[0]
    if before:
        n = len(words_of(pa.array([before], pa.large_string()))[0])
        if 0 < n < n_words:
            return n
    return max(1, math.ceil(n_words * 2 / 3))


@dataclass(frozen=True)
class Whole:
    """What the weights need to know of all items: how many have words, and their mean length."""

    n: int
    mean: float


def build(items: list[tuple[int, str]], known: dict[int, int], whole: Whole, least: float) -> Index | None:
    """The index of some of the items. ``known``: in how many of all items each term (by hash) stands."""
    words, owner = words_of(pa.array([t for _, t in items], pa.large_string()))
    count = np.bincount(owner, minlength=len(items))
    if not len(words):
        return None
    begin = np.searchsorted(owner, np.arange(len(items) + 1))
    terms, code = np.unique(words, return_inverse=True)
    pairs, tf = np.unique(owner * len(terms) + code, return_counts=True)
    item, term = pairs // len(terms), pairs % len(terms)
    df = np.array([known[t] for t in terms.view(np.int64).tolist()], np.float64)
    idf = np.log(1 + (whole.n - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * count[item] / whole.mean))
    runs, question, floor = [], [], np.ones(len(items))
    for i, (_, text) in enumerate(items):
        own = words[begin[i] : begin[i + 1]]
        run, _ = shingles(own, np.zeros(len(own), np.int64), SIZE)
        runs.append(run)
        cut = question_length(text, len(own))
        question.append(np.arange(len(run)) + min(SIZE, len(own)) <= max(cut, min(SIZE, len(own))))
        # a passage may lack as many words as it may lack runs: the heaviest of them
        mine = np.sort(weight[item == i])[::-1]
        floor[i] = mine[int(len(run) - math.ceil(least * len(run) - 1e-9)) :].sum() if len(run) else 1
    weight = weight / np.maximum(floor[item], 1e-9)
    most = np.zeros(len(terms))
    np.maximum.at(most, term, weight)
    number = np.empty(len(terms), np.int64)
    number[np.argsort(most, kind="stable")] = np.arange(len(terms))
    term, most = number[term], np.sort(most, kind="stable")
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order], weight[order]
    cell = term * (len(items) // BLOCK + 1) + item // BLOCK
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    window = np.maximum(LEAST_WINDOW, np.ceil(WINDOW * count)).astype(np.int64)
    return Index(
        [i for i, _ in items], terms, np.searchsorted(terms >> np.uint64(48), np.arange(65537, dtype=np.uint64)), number, most, np.searchsorted(term[first], np.arange(len(terms) + 1)), (item // BLOCK)[first], np.maximum.reduceat(weight, first),
        np.r_[first, len(cell)], item, weight, runs, question, window, int(window.max()),
    )


def look_up(index: Index, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are terms, and those terms' numbers."""
    lead = (words >> np.uint64(48)).astype(np.int64)
    at, end = index.opening[lead], index.opening[lead + 1]
    todo = np.flatnonzero(at < end)
    found = np.full(len(words), -1, np.int64)
    at = at[todo]
    while len(todo):
        same = index.hashes[at] == words[todo]
        found[todo[same]] = index.number[at[same]]
        more = ~same & (at + 1 < end[todo])
        todo, at = todo[more], at[more] + 1
    hit = np.flatnonzero(found >= 0)
    return hit, found[hit]


def block_bounds(index: Index, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """By passage (of ``n``) and block: the sum of the terms' largest weights in the block."""
    size = index.block_from[term + 1] - index.block_from[term]
    where = ragged(index.block_from[term], size)
    n_blocks = len(index.item_ids) // BLOCK + 1
    return np.bincount(np.repeat(passage * n_blocks, size) + index.blocks[where], index.block_most[where], n * n_blocks).reshape(n, n_blocks)


def retrieve(index: Index, words: np.ndarray, owner: np.ndarray, stride: int) -> tuple[np.ndarray, ...]:
    """Passages that reach 1 for an item: the passage's first word, its last word + 1, item and score.

    A passage is 2 x ``stride`` words; the next begins ``stride`` words later, so an item's window always fits into one."""
    if not len(words):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    length = np.diff(np.r_[first, len(words)])
    passages = np.maximum(1, -(-length // stride) - 1)
    base = np.cumsum(passages) - passages
    text = np.repeat(np.arange(len(first)), length)
    hit, at = look_up(index, words)
    chunk = (hit - first[text[hit]]) // stride
    own, before = chunk < passages[text[hit]], chunk > 0
    n_terms, start = len(index.most), base[text[hit]] + chunk
    keys = np.sort(np.r_[(start[own]) * n_terms + at[own], (start[before] - 1) * n_terms + at[before]])
    if not len(keys):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    passage = keys // n_terms
    term = keys - passage * n_terms
    # the pivot: light terms that cannot reach 1 together
    running = np.cumsum(index.most[term])
    opens = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    running -= np.repeat(np.r_[0, running][opens], np.diff(np.r_[opens, len(keys)]))
    light = running < 1 - SLACK
    rest = np.bincount(passage[light], index.most[term[light]], int(passage[-1]) + 1)
    n_blocks, cells = len(index.item_ids) // BLOCK + 1, []
    many = max(1, CELLS // n_blocks)
    for low in range(0, int(passage[-1]) + 1, many):  # so many passages at a time, all blocks of each
        span, n = slice(*np.searchsorted(passage, (low, low + many))), min(many, len(rest) - low)
        p, t, heavy = passage[span] - low, term[span], ~light[span]
        # bounds of the blocks that essential terms touch, as if each held the light terms too
        bound = block_bounds(index, p[heavy], t[heavy], n)
        bound[bound + rest[low : low + n, None] < 1 - SLACK] = 0
        # then with what it does hold of them
        some = heavy < bound.any(1)[p]
        bound[bound > 0] += block_bounds(index, p[some], t[some], n)[bound > 0]
        cells.append(np.flatnonzero(bound >= 1 - SLACK) + low * n_blocks)
    cells = np.concatenate(cells)
    if not len(cells):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    # scores of the items of those blocks, over all terms of the passage
    p, block = cells // n_blocks, cells % n_blocks
    low, high = np.searchsorted(passage, p), np.searchsorted(passage, p, "right")
    t = term[ragged(low, high - low)]
    cell = np.repeat(np.arange(len(cells)), high - low)
    term_block = np.repeat(np.arange(n_terms), np.diff(index.block_from)) * n_blocks + index.blocks
    want = t * n_blocks + block[cell]
    there = np.minimum(np.searchsorted(term_block, want), len(term_block) - 1)
    ok = term_block[there] == want
    there, cell = there[ok], cell[ok]
    size = index.post_from[there + 1] - index.post_from[there]
    where = ragged(index.post_from[there], size)
    found, code = np.unique(np.repeat(p[cell], size) * len(index.item_ids) + index.post_item[where], return_inverse=True)
    score = np.bincount(code, index.post_weight[where], len(found))
    found, score = found[score >= 1 - SLACK], score[score >= 1 - SLACK]
    p, item = found // len(index.item_ids), found % len(index.item_ids)
    which = np.searchsorted(base, p, "right") - 1
    begin = first[which] + (p - base[which]) * stride
    return begin, np.minimum(begin + 2 * stride, first[which] + length[which]), item, score


def leaks(documents: DataFrame, benchmark: DataFrame, *, least: float = 0.8, least_part: float = 0.5, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap: a row per document and test item that it holds.

    ``documents(doc_id, text)``, ``benchmark(item_id, text)``. Held: a window of half as many words again as the item's has at least ``least`` of the item's five-word runs (an item
    under five words is one run) and at least ``least_part`` of those of its question and of its answer. Letter case and ASCII
    punctuation don't count. The score is BM25 over the least that such a passage reaches. Null or wordless texts and
    items match nothing; rows that repeat give repeated results, items that repeat count once; a null doc_id or item_id stays null. With an empty table there is no row.
    Items beyond ``index_bytes`` make further indexes; the statistics are those of all items, so the rows don't depend on it.
    """
    schema = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"

    def against(parts) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, column in slices(batch):
                    held = held_items(parts.value, column, least, least_part)
                    ids = rows.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[o] for o, _, _ in held], pa.int64()), pa.array([parts.value[p].item_ids[i] for _, p, i in held], pa.int64()), *(pa.array([v[k] for v in held.values()], pa.float64()) for k in (3, 0, 1, 2))],
                        ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"],
                    )

        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, [against(p) for p in indexes(benchmark, least, index_bytes)])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different terms of each item, and its number of words with the first of them."""
    for batch in batches:
        words, owner = words_of(texts(batch.column("text")))
        if not len(words):
            continue
        count = np.bincount(owner, minlength=batch.num_rows)
        order = np.lexsort((words, owner))
        words, owner = words[order], owner[order]
        opens = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])])
        head = np.r_[True, owner[opens][1:] != owner[opens][:-1]]
        yield pa.RecordBatch.from_arrays([batch.column("part").take(pa.array(owner[opens])), pa.array(words[opens].view(np.int64)), pa.array(np.where(head, count[owner[opens]], 0))], ["part", "term", "n_words"])


def indexes(benchmark: DataFrame, least: float, index_bytes: int = INDEX_BYTES, at_a_time: int = AT_A_TIME) -> list:
    """Broadcast lists of indexes of all items. An index holds about ``index_bytes`` of their text, and is built in a task of its own;
    a list holds ``at_a_time`` indexes, and documents are read once for each list."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).dropDuplicates()
    length = F.greatest(F.octet_length("text"), F.lit(CLASS_BYTES))
    items = items.withColumn("_class", F.ceil(F.log(4.0, length / CLASS_BYTES)).cast("int"))
    parts, here = 0, F.lit(0)
    for row in items.groupBy("_class").agg(F.sum(F.octet_length("text")).alias("total")).orderBy("_class").collect():  # a row for each four times of length
        n = max(1, -(-row["total"] // index_bytes))
        here = F.when(F.col("_class") == row["_class"], parts + F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).otherwise(here)
        parts += n
    items = items.withColumn("part", here.cast("int")).drop("_class")
    terms = cut(items.select("part", "text").mapInArrow(_item_terms, "part int, term long, n_words long"))
    x = terms.where("n_words > 0").agg(F.count("*").alias("n"), F.sum("n_words").alias("words")).first()
    context = benchmark.sparkSession.sparkContext
    if not x["n"]:
        return [context.broadcast([])]
    whole = Whole(x["n"], x["words"] / x["n"])
    known = terms.groupBy("term").agg(F.count("*").alias("df"), F.collect_set("part").alias("parts"))  # at most as many as indexes
    told = known.select(F.explode("parts").alias("part"), "term", "df", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish() -> pa.RecordBatch:
            made = build(rows, df, whole, least)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(made)], pa.binary())], ["part", "packed"])

        part, df, rows = None, {}, []
        for batch in batches:
            for p, term, n, item, text in zip(*(batch.column(c).to_pylist() for c in ("part", "term", "df", "item_id", "text")), strict=True):
                if p != part:
                    if part is not None:
                        yield finish()
                    part, df, rows = p, {}, []
                if term is None:
                    rows.append((item, text))
                else:
                    df[term] = n
        if part is not None:
            yield finish()

    both = told.unionByName(items.withColumn("term", F.lit(None).cast("long")).withColumn("df", F.lit(None).cast("long")))
    built = cut(both.repartition("part").sortWithinPartitions("part", "item_id", "text").mapInArrow(run, "part int, packed binary"))
    out = []
    for first in range(0, parts, at_a_time):
        made = [pickle.loads(r["packed"]) for r in built.where(F.col("part").between(first, first + at_a_time - 1)).orderBy("part").collect()]
        out.append(context.broadcast([m for m in made if m]))
    return out


def held_items(parts: list[Index], column: pa.Array, least: float, least_part: float) -> dict[tuple[int, int, int], tuple[float, ...]]:
    """By text, index and item that it holds: the overlap, question's and answer's overlap of its best window, and the score of that window's passage."""
    best: dict[tuple[int, int, int], tuple[float, ...]] = {}
    if not parts:
        return best
    words, owner = words_of(column)
    for part, index in enumerate(parts):
        for b, e, i, s in zip(*(x.tolist() for x in retrieve(index, words, owner, index.stride)), strict=True):
            key = (int(owner[b]), part, i)
            for found in windows(shingles(words[b:e], owner[b:e], SIZE)[0], index.runs[i], index.question[i], int(index.window[i]), least, least_part):
                best[key] = max(best.get(key, (0.0,)), (*found, round(s, 9)))
    return best


def windows(passage: np.ndarray, runs: np.ndarray, asked: np.ndarray, window: int, least: float, least_part: float) -> Iterator[tuple[float, float, float]]:
    """The overlap, question's and answer's overlap of windows of a passage (its runs in order) that hold enough of an item's runs, each window beginning with one of them."""
    places = np.flatnonzero(np.isin(passage, runs))
    need = math.ceil(least * len(runs) - 1e-9)
    if not len(places) or np.isin(runs, passage[places]).sum() < need:
        return
    ends = np.searchsorted(places, places + window - SIZE, "right")
    fewest = need - (len(runs) - len(np.unique(runs)))  # runs that an item repeats count each time
    for a, z in enumerate(ends.tolist()):
        if z - a < fewest or (a and z == ends[a - 1]):  # too few, or part of the window before
            continue
        held = np.isin(runs, passage[places[a:z]])
        overlap = held.mean()
        question = held[asked].mean() if asked.any() else overlap
        answer = held[~asked].mean() if not asked.all() else overlap
        if overlap >= least - 1e-9 and min(question, answer) >= least_part - 1e-9:
            yield float(overlap), float(question), float(answer)
            if overlap == 1:
                return


def drop_leaked(documents: DataFrame, benchmark: DataFrame, *, least: float = 0.8, least_part: float = 0.5, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``documents`` that hold no test item (as ``leaks`` finds them), with all their columns. Rows without text, and rows that repeat, are judged like others; without items all rows stay, and of no rows none. No document is shuffled."""
    for parts in indexes(benchmark, least, index_bytes):

        def run(batches: Iterator[pa.RecordBatch], parts=parts) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, column in slices(batch):
                    leaked = {o for o, _, _ in held_items(parts.value, column, least, least_part)}
                    yield rows.filter(pa.array([k not in leaked for k in range(rows.num_rows)], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
