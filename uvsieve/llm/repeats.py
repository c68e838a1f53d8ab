"""Repeated passages: every byte covered by a ``length``-byte string that also starts earlier.

Suffix sorting of a whole corpus doesn't split over machines, so the corpus is first cut into short
strings that can be sorted apart without missing a match. In each ``length``-byte window the
``GRAM``-byte gram of least hash (leftmost first) is the window's *anchor*. Equal windows have equal
anchors at equal places, so only texts around equal anchors need comparing. Windows in a row that share an anchor
make one segment. Segments whose anchor occurs once in the corpus end there.

The other segments, grouped by anchor and aligned on it, are the documents of a column-wise
construction: going from the last column to the first, each round inserts one symbol for every
segment, and from the order of the suffixes that start one column later it derives, in one
sequential pass over the arrays, the order of those that start here (a stable sort by the
inserted symbol - the transform) and the length of their common prefixes. Where common prefixes reach ``length``,
suffixes start with the same window; all but the earliest in the corpus are repeats.

Copies of a whole segment stream past and never enter the construction.

A window has its anchor at one of 81 places. An anchor that has more than a ``SHARE`` of what a task deals with on average (told by a sample; such anchors
are few, whatever the corpus) is frequent: its segments are cut into three, by
the anchor's place in the window, and each third is grouped by all the bytes that its windows have in common, not by the anchor alone.
Equal segments are then folded into the earliest (in part before the shuffle, by their bytes), and what
is left of a group goes through the same construction. A group that still has too many different segments is cut into
three again: 81 = 3^4, so after four cuts a group is one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, ragged, slices, utf8

LENGTH = 100
GRAM = 20
#: The share of a task's segments that one anchor may have.
SHARE = 0.25
#: Bytes of text, about, from which frequent anchors are told: at least, and for each partition.
SAMPLE_BYTES, SAMPLE_PART = 16 << 20, 64 << 10
#: Places of the anchor in a window that a segment's part covers, from cut to cut.
CUTS = (27, 9, 3, 1)
#: Window starts that one numpy step handles; places in it must fit 24 bits.
STEP = 1 << 20
#: Different segments that one construction holds.
SEGMENTS = 6_000


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of the ``size`` bytes that begin at each place (shorter by size-1 than the data)."""
    with np.errstate(over="ignore"):
        part, width, factor = mix64(np.arange(256, dtype=np.uint64) + np.uint64(77))[data], 1, 0x9E3779B97F4A7C15
        done, have = None, 0
        left = size
        while left:
            if left & 1:
                if done is None:
                    done, have = part, width
                else:
                    n = min(len(done) - width, len(part)) if len(done) > width else 0
                    done, have = (done[width : width + n] + part[:n] * np.uint64(pow(factor, have, 2**64)))[: max(n, 0)], have + width
            left >>= 1
            if left:
                n = max(len(part) - width, 0)
                part = part[:n] * np.uint64(pow(factor, width, 2**64)) + part[width : width + n]
                width *= 2
        return mix64(done[: max(len(data) - size + 1, 0)])


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchor hash, anchor place, first window start and last window start of every segment."""
    reach = length - GRAM  # an anchor starts at most so far from its window's start
    out: list[tuple[np.ndarray, ...]] = []
    stop = np.repeat(ends[1:], np.diff(ends))
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP + length - 1]
        n = min(STEP, len(part) - length + 1)
        if n <= 0:
            continue
        hashes = gram_hashes(part)
        packed = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        least, width = packed, 1
        while width * 2 <= reach + 1:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        extra = reach + 1 - width
        least = np.minimum(least[: len(least) - extra], least[extra:]) if extra else least
        anchor = (least[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
        valid = np.arange(at, at + n) + length <= stop[at : at + n]
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        finishes = valid.copy()
        finishes[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
        # a text that starts here begins a segment of its own
        inner = ends[np.searchsorted(ends, at + 1) : np.searchsorted(ends, at + n)] - at
        begins[inner] |= valid[inner]
        finishes[inner - 1] |= valid[inner - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(finishes)
        out.append((hashes[anchor[first]], anchor[first] + at, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)


def _anchor_rows(frequent: np.ndarray):
    """The different anchors of each text, and how often each stands in it, but for those that are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, column in slices(batch):
                data, ends = utf8(column)
                hashes, _, first, _ = segments(data, ends)
                owner = np.searchsorted(ends, first, "right") - 1
                if len(frequent):
                    rare = ~np.isin(hashes, frequent)
                    hashes, owner = hashes[rare], owner[rare]
                order = np.lexsort((hashes, owner))  # a text that repeats itself has few anchors, many times
                hashes, owner = hashes[order], owner[order]
                opens = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]) if len(hashes) else np.zeros(0, np.int64)
                times = np.diff(np.r_[opens, len(hashes)])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[opens].view(np.int64)), pa.array(rows.column("_doc").to_numpy()[owner[opens]]), pa.array(times.astype(np.int32))], ["anchor", "doc_id", "times"])

    return run


def frequent_anchors(documents: DataFrame, share: float) -> tuple[np.ndarray, int]:
    """Anchors with over ``share`` of a task's average segments, rising, and how many segments that is: by a sample, of which at most partitions / share numbers come back."""
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    one_in = max(1, size // max(SAMPLE_BYTES, partitions * SAMPLE_PART))
    some = documents.where(F.pmod(F.xxhash64("_doc", "_twin", F.lit(6)), F.lit(one_in)) == 0).select("_doc", "text").mapInArrow(_anchor_rows(np.zeros(0, np.uint64)), "anchor long, doc_id long, times int")
    counts = some.groupBy("anchor").agg(F.sum("times").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    found = counts.crossJoin(F.broadcast(total)).where((F.col("n") > 3) & (F.col("n") * partitions > share * F.col("total"))).select("anchor", "total").collect()
    limit = max(1, int(share * one_in * found[0]["total"] / partitions)) if found else 1
    return np.array(sorted(r["anchor"] % 2**64 for r in found), np.uint64), limit


def _listed(rows: pa.RecordBatch, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which segments have an anchor that is listed for their text."""
    lists = rows.column("anchors")
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    listed = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    with np.errstate(over="ignore"):
        salt = lambda o: mix64(o.astype(np.uint64) + np.uint64(1))
        return np.isin(hashes ^ salt(owner), flat ^ salt(listed))


SEGMENT = "key long, doc_id long, twin int, place long, before int, content binary"
SEGMENT_NAMES = [f.split()[0] for f in SEGMENT.split(", ")]


def _binary(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes of each run, as one binary array."""
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32).tobytes()), pa.py_buffer(data[ragged(start, size)].tobytes())])


def _segment_rows(frequent: np.ndarray | None = None):
    """Of frequent anchors, or else those listed for each text: anchor, document, anchor's place in it, how far before it the segment begins, and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, column in slices(batch):
                data, ends = utf8(column)
                hashes, place, first, last = segments(data, ends)
                owner = np.searchsorted(ends, first, "right") - 1
                keep = _listed(rows, hashes, owner) if frequent is None else np.isin(hashes, frequent)
                hashes, place, first, last, owner = (x[keep] for x in (hashes, place, first, last, owner))
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), rows.column("_doc").take(own), rows.column("_twin").take(own), pa.array(place - ends[owner]), pa.array((place - first).astype(np.int32)), _binary(data, first, last - first + LENGTH)],
                    SEGMENT_NAMES,
                )

    return run


def _split(width: int):
    """Segments cut by the anchor's place in the window into parts of ``width`` places; a part's key is a hash of the bytes that all its windows have, and of which part it is."""
    fixed = LENGTH - width + 1
    reach = LENGTH - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch.column("content")
            size = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
            data, ends = np.frombuffer(content.buffers()[2], np.uint8)[size[0] : size[-1]] if len(content) else np.zeros(0, np.uint8), size - size[:1]
            before = batch.column("before").to_numpy().astype(np.int64)
            high, low = before, before - (np.diff(ends) - LENGTH)  # the anchor's places in the first and in the last window
            parts = high // width - low // width + 1
            row = np.repeat(np.arange(len(content)), parts)
            part = high[row] // width - ragged(np.zeros(len(parts), np.int64), parts)
            top, bottom = np.minimum(high[row], part * width + width - 1), np.maximum(low[row], part * width)
            anchor = ends[row] + before[row]
            hashes = gram_hashes(data, fixed)
            # all windows of the part hold what lies from its least place before the anchor on
            with np.errstate(over="ignore"):
                key = mix64(hashes[anchor - part * width] + (part + reach * width).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), *(batch.column(n).take(own) for n in ("doc_id", "twin", "place")), pa.array(top.astype(np.int32)), _binary(data, anchor - top, top - bottom + LENGTH)], SEGMENT_NAMES
            )

    return run


def construct(columns: np.ndarray, starts: int, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Columns of aligned segments, last first: yields (column, order, common) for the first ``starts`` columns.

    ``order``: the segments sorted by what starts in that column; ``common[k]``: how many symbols the k-th shares
    with the one before it (``length`` at most). Each round inserts one symbol per segment.
    """
    m, width = columns.shape
    by_column = np.ascontiguousarray(columns.T)
    order, common = np.arange(m), np.zeros(m, np.int16)
    # suffixes past the last column are all empty, hence equal: nothing in common is known of the first alone
    common[1:] = 0
    for column in range(width - 1, -1, -1):
        symbols = by_column[column][order]  # the transform: what stands before each suffix, in their order
        move = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[move]
        fresh = np.zeros(m, np.int16)
        same = np.flatnonzero(sorted_symbols[1:] == sorted_symbols[:-1]) + 1
        if len(same):
            low, high = move[same - 1] + 1, move[same] + 1  # least common prefix over what lies between
            close = high - low == 1
            least = np.empty(len(same), np.int16)
            least[close] = common[low[close]]
            if not close.all():
                far = np.flatnonzero(~close)
                bounds = np.empty(2 * len(far), np.int64)
                bounds[::2], bounds[1::2] = low[far], high[far]
                least[far] = np.minimum.reduceat(np.r_[common, np.int16(0)], bounds)[::2]
            fresh[same] = np.minimum(least + 1, length)
        order, common = order[move], fresh
        if column < starts:
            yield column, order, common


def repeated_windows(content: list[np.ndarray], before: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Per segment and column: whether the window that starts there also starts earlier (by ``rank``).

    The anchor stands in column ``length - GRAM`` of the matrix."""
    reach, m = length - GRAM, len(content)
    # symbols are byte + 1; places outside of a segment hold 0
    columns = np.zeros((m, reach + length), np.uint16)
    size = np.array([len(c) for c in content])
    row = np.repeat(np.arange(m), size)
    columns[row, ragged(reach - before, size)] = np.concatenate(content).astype(np.uint16) + 1
    repeated = np.zeros((m, reach + 1), bool)
    valid_first, valid_last = reach - before, reach - before + size - length
    for column, order, common in construct(columns, reach + 1, length):
        first = np.flatnonzero(common < length)
        counts = np.diff(np.r_[first, m])
        if counts.max() == 1:
            continue
        earliest = np.repeat(np.minimum.reduceat(rank[order], first), counts)
        repeated[order, column] = rank[order] > earliest
    inside = (np.arange(reach + 1) >= valid_first[:, None]) & (np.arange(reach + 1) <= valid_last[:, None])
    return repeated & inside


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments in order of key, content, document and place: the repeated spans (doc_id, twin, start, stop)."""
    held: list[tuple] = []  # different segments: key, content, before, doc_id, twin, place

    def finish(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        if len(rows) < 2:
            return (np.zeros(0, np.int64),) * 4
        _, content, before, *rest = zip(*rows, strict=True)
        before, (doc, twin, place) = np.array(before, np.int64), (np.array(x, np.int64) for x in rest)
        rank = np.empty(len(rows), np.int64)
        rank[np.lexsort((place, twin, doc))] = np.arange(len(rows))
        # segments of different keys may be handled together: they have no window in common
        repeated = np.pad(repeated_windows([np.frombuffer(c, np.uint8) for c in content], before, rank).astype(np.int8), ((0, 0), (1, 1)))
        edge = np.diff(repeated, axis=1)
        row, start = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        begin = place[row] - (LENGTH - GRAM)
        return doc[row], twin[row], begin + start, begin + stop - 1 + LENGTH

    def batch_of(parts: list[tuple]) -> pa.RecordBatch:
        doc, twin, start, stop = (np.concatenate([np.asarray(p[k], np.int64) for p in parts]) for k in range(4))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(twin.astype(np.int32)), pa.array(start), pa.array(stop)], ["doc_id", "twin", "start", "stop"])

    last: tuple | None = None
    for batch in batches:
        copies: list[tuple] = []
        parts: list[tuple] = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "before", "doc_id", "twin", "place")), strict=True):
            if last is not None and row[:3] == last[:3]:
                if row[3:] != last[3:]:  # a copy of the whole segment, later in the corpus
                    begin = row[5] - row[2]
                    copies.append((row[3], row[4], begin, begin + len(row[1])))
                continue
            if last is not None and row[0] != last[0] and len(held) >= SEGMENTS:
                parts.append(finish(held))
                held = []
            last = row
            held.append(row)
        parts.append(tuple(zip(*copies, strict=True)) if copies else ((),) * 4)
        yield batch_of(parts)
    if held:
        yield batch_of([finish(held)])


SPAN = "doc_id long, twin int, start long, stop long"


def _constructed(found: DataFrame) -> DataFrame:
    return found.repartition("key").sortWithinPartitions("key", "content", "before", "doc_id", "twin", "place").mapInArrow(_span_rows, SPAN)


def _frequent_spans(found: DataFrame, limit: int) -> DataFrame:
    """Spans of segments whose key is too frequent for one task."""
    out = []
    for width in CUTS:
        parts = found.mapInArrow(_split(width), SEGMENT)
        same = ["key", "content", "before"]
        firsts = cut(parts.groupBy(*same).agg(F.min(F.struct("doc_id", "twin", "place")).alias("first"), F.count("*").alias("n")))
        # copies of a whole part: all but the earliest go. A row finds its group by a name of 128 bits, which no two groups share
        seed = 0
        while True:
            name = [F.xxhash64("key", "before", "content", F.lit(seed)).alias("h1"), F.xxhash64(F.lit(seed), "content", "key").alias("h2")]
            if not firsts.groupBy(*name).count().where("count > 1").limit(1).count():
                break
            seed += 1
        rows = parts.select(*name, "doc_id", "twin", "place", (F.col("place") - F.col("before")).alias("start"), F.length("content").alias("size"))
        copies = rows.join(firsts.where("n > 1").select(*name, "first"), ["h1", "h2"]).where(F.struct("doc_id", "twin", "place") != F.col("first"))
        out.append(copies.select("doc_id", "twin", "start", (F.col("start") + F.col("size")).alias("stop")))
        different = firsts.select(*same, "first.*")
        sizes = firsts.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        out.append(_constructed(different.join(sizes.where(F.col("m") <= limit), "key", "left_semi")))
        large = cut(sizes.where(F.col("m") > limit).select("key"))
        if not large.limit(1).count():
            break
        found = different.join(large, "key", "left_semi").select(*SEGMENT_NAMES)
    return reduce(DataFrame.union, out)


def repeated_spans(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, twin, start, stop): byte spans of ``documents(_doc, _twin, text, ...)`` covered by windows that also start earlier. They may overlap."""
    frequent, limit = frequent_anchors(documents, share)
    listed = documents.select("_doc", "text").mapInArrow(_anchor_rows(frequent), "anchor long, doc_id long, times int").repartition("anchor")  # shuffled once for both sides; no anchor is frequent
    # both sides read all columns, so that one exchange serves them
    counts = listed.groupBy("anchor").agg(F.sum("times").alias("n"), F.max("doc_id").alias("last")).where((F.col("n") > 1) & F.col("last").isNotNull()).select("anchor")
    repeated = listed.join(counts.hint("shuffle_hash"), "anchor").groupBy(F.col("doc_id").alias("_doc"))
    chosen = cut(repeated.agg(F.collect_set(F.when(F.col("times") > 0, F.col("anchor"))).alias("anchors")))
    spans = _constructed(documents.join(chosen, "_doc").mapInArrow(_segment_rows(), SEGMENT))  # all columns, as in the join with the spans: one exchange serves both
    return spans.union(_frequent_spans(documents.select("_doc", "_twin", "text").mapInArrow(_segment_rows(frequent), SEGMENT), limit)) if len(frequent) else spans


def _left(content: np.ndarray, found: list | None) -> tuple[bytes, int]:
    """What spans leave of a text, and how many maximal runs they make."""
    if not found:
        return content.tobytes(), 0
    pairs = np.array([(s["start"], s["stop"]) for s in found], np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    high = np.maximum.accumulate(pairs[:, 1])
    opens = np.r_[True, pairs[1:, 0] > high[:-1]]
    start, stop = pairs[opens, 0], high[np.r_[np.flatnonzero(opens)[1:] - 1, len(high) - 1]]
    keep = np.zeros(len(content) + 1, np.int32)
    keep[start] += 1
    keep[stop] -= 1
    return content[np.cumsum(keep)[:-1] == 0].tobytes(), len(start)


def _each_left(rows: pa.RecordBatch, column: pa.Array) -> list[tuple[bytes, int]]:
    data, ends = utf8(column)
    spans, twins = rows.column("_spans").to_pylist(), rows.column("_twin").to_pylist()
    return [_left(data[ends[i] : ends[i + 1]], found and [s for s in found if s["twin"] == twin]) for i, (found, twin) in enumerate(zip(spans, twins, strict=True))]


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, column in slices(batch):
            left, n_bytes = _each_left(rows, column), np.diff(utf8(column)[1])
            kept = [k for k, _ in left]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n_bytes), pa.array(n_bytes - np.array([len(k) for k in kept], np.int64)), pa.array([n for _, n in left], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def _identified(documents: DataFrame, *columns: str) -> DataFrame:
    """With ``_doc``, where a document stands in the corpus (behind all others, by a hash of its text, if it has no doc_id), and ``_twin``, which tells texts of one doc_id apart."""
    behind = F.lit(2**62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    return documents.select(*columns, F.coalesce(F.col("doc_id").cast("long"), behind).alias("_doc"), F.hash("text").alias("_twin"))


def _with_spans(documents: DataFrame, share: float, *columns: str) -> DataFrame:
    rows = _identified(documents, *columns)
    spans = repeated_spans(rows, share).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("twin", "start", "stop")).alias("_spans"))
    return rows.join(spans, "_doc", "left").select(*columns, "_twin", "_spans")


def remove_repeats(documents: DataFrame, *, share: float = SHARE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of every row of ``documents(doc_id, text)``.

    A null text is empty; a text under 100 bytes loses nothing. Of equal windows the one with the least (doc_id, start) stays; documents without doc_id
    come last. Rows that repeat a doc_id with the same text count as one document and all get its result; different texts of one doc_id
    are documents of their own, in order of a hash. An empty table gives an empty one. Other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_spans(rows, share, "doc_id", "text").mapInArrow(_kept_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def cut_repeats(documents: DataFrame, *, share: float = SHARE) -> DataFrame:
    """``documents`` with what ``remove_repeats`` leaves of each text, n_chars (if there) to match, and all other columns as they were.

    A character of which only some bytes are left goes whole. No row goes; a null text stays null. Ties and repeated rows are as in ``remove_repeats``;
    no rows give none.
    """
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, column in slices(batch):
                missing = rows.column("text").is_null().to_pylist()
                text = [None if none else k.decode(errors="ignore") for (k, _), none in zip(_each_left(rows, column), missing, strict=True)]
                new = {"text": pa.array(text, pa.string()), "n_chars": pa.array([len(t or "") for t in text], pa.int64())}
                yield pa.RecordBatch.from_arrays([new[n].cast(rows.schema.field(n).type) if n in new else rows.column(n) for n in names], names)

    return _with_spans(documents, share, *names).mapInArrow(run, documents.schema)
