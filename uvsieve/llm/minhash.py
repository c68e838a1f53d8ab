"""Near-duplicate classes by BagMinHash.

A document is a bag of five-word shingles; a shingle's weight is how often it occurs. Every
shingle runs independent Poisson processes over its weight: one over the first unit, one over
the second, then one over each doubling (3-4, 5-8, ...). Points come in order of time; a point
of a doubling that the weight only partly covers counts if its place is covered. Each point
falls into one slot of the signature, which keeps its earliest time. Two bags agree in a slot
with a chance equal to their weighted Jaccard likeness. A process stops once its next point is
later than every slot's.

Then: equal texts fold into one representative; signatures are cut into bands; within a band's bucket,
documents whose signatures agree well are tied into coarse groups; within a coarse group
the overlap of the bags themselves decides, for every pair that could still join two
classes. A group too large for one task is compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, slices, sorted_groups, utf8, written
from .components import components
from .words import shingles, span_hashes, spans

SLOTS = 64
ROWS = 4  # slots in a band: 16 bands; a pair at 0.8 meets in none with a chance of 2e-4
SIZE = 5
#: Signatures that agree in a smaller share of slots are of bags under 0.8 alike but for one in 10^6.
COARSE = 0.55
#: Members of a bucket, and documents of a block, that one task compares with each other.
BUCKET = 4_096
BLOCK = 6_000


def bags(data: np.ndarray, ends: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles, how often each occurs and in which text, sorted by text and shingle."""
    starts, stops, owner = spans(data, ends)
    hashes, owner = shingles(span_hashes(data, starts, stops), owner, size)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.diff(np.r_[first, len(hashes)]), owner[first]


def signatures(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """The earliest time in each slot, a row per text (all infinite where a text has no shingle)."""
    times = np.full(n * slots, np.inf)
    levels = np.where(weights <= 1, 1, 1 + np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64))
    element = np.repeat(np.arange(len(hashes)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    start = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    length = np.maximum(start, 1)
    weight, text = weights[element], owner[element]
    with np.errstate(over="ignore"):
        seed = mix64(hashes[element] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.zeros(len(element))
        step = np.uint64(0)
        latest = np.full(n, np.inf)
        while len(element):
            step += np.uint64(1)
            draw = mix64(seed + step * np.uint64(0xBF58476D1CE4E5B9))
            second = mix64(draw ^ np.uint64(0x94D049BB133111EB))
            at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / (slots * length)
            soon = at < latest[text]
            if not soon.all():
                seed, at, text, start, length, weight, second, element = (x[soon] for x in (seed, at, text, start, length, weight, second, element))
            slot = (second % np.uint64(slots)).astype(np.int64)
            place = start + ((second >> np.uint64(32)).astype(np.float64) * 2.0**-32 * length).astype(np.int64)
            covered = place < weight
            np.minimum.at(times, text[covered] * slots + slot[covered], at[covered])
            latest = times.reshape(n, slots).max(1)
    return times.reshape(n, slots)


def marks(times: np.ndarray) -> np.ndarray:
    """What is kept of the times: 32 bits each, robust against the last digits of a logarithm."""
    return times.astype(np.float32).view(np.uint32)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, slots = signature.shape
    keys = np.zeros((n, slots // rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            keys = mix64(keys * np.uint64(31) + signature[:, k::rows][:, : slots // rows].astype(np.uint64) + np.uint64(1))
        keys = mix64(keys + np.arange(slots // rows, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def text_keys(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each text's words in order, and the texts of the words."""
    starts, stops, owner = spans(data, ends)
    words = span_hashes(data, starts, stops)
    keys = np.zeros((len(ends) - 1, 2), np.uint64)
    with np.errstate(over="ignore"):
        rank = np.arange(len(words)) - np.searchsorted(owner, owner)
        for k, salt in enumerate((0xA24BAED4963EE407, 0x9FB21C651E98DF25)):
            np.add.at(keys[:, k], owner, mix64(mix64(words + np.uint64(salt)) + rank.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return keys, owner


def _with_keys(documents: DataFrame) -> DataFrame:
    """doc_id, k1, k2 and text of rows with a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, column in slices(batch):
                keys, _ = text_keys(*utf8(pc.utf8_lower(column)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(np.ascontiguousarray(keys[:, k]).view(np.int64)) for k in (0, 1)), rows.column("text")], ["doc_id", "k1", "k2", "text"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, k1 long, k2 long, text string")


def signed(documents: DataFrame) -> DataFrame:
    """doc_id, text key (of the words), band keys and a byte of each slot. A text without words has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, column in slices(batch):
                column = pc.utf8_lower(column)
                data, ends = utf8(column)
                n = len(column)
                keys, owner = text_keys(data, ends)
                signature = marks(signatures(*bags(data, ends), n))
                bare = np.bincount(owner, minlength=n)[:n] == 0
                bands = pa.array([[] if b else k for b, k in zip(bare, band_keys(signature).tolist(), strict=True)], pa.list_(pa.int64()))
                small = (mix64(signature.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), bands, pa.array([x.tobytes() for x in small], pa.binary())],
                    ["doc_id", "k1", "k2", "bands", "slots"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, k1 long, k2 long, bands array<long>, slots binary")


def _tie(ids: np.ndarray, slots: np.ndarray, share: float) -> list[tuple[int, int]]:
    """A forest over the documents of a bucket: ties between signatures that agree."""
    least, links, todo = share * slots.shape[1], [], np.arange(len(ids))
    while len(todo) > 1:
        frontier, todo = [todo[0]], todo[1:]
        while frontier and len(todo):
            i = frontier.pop()
            near = (slots[todo] == slots[i]).sum(1) >= least
            links += [(int(ids[j]), int(ids[i])) for j in todo[near]]
            frontier += todo[near].tolist()
            todo = todo[~near]
    return links


def coarse_links(members: DataFrame, bucket: int = BUCKET, share: float = COARSE) -> DataFrame:
    """Ties (a, b) within the buckets of ``members(band, doc, slots)``. A bucket beyond ``bucket`` is gone through in
    runs of that many; then every member of it is also tied to its first, which only makes the group coarser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        opened: tuple[int, int] | None = None  # the band and the first member of a bucket that goes on

        def flush(last: bool) -> tuple[list, list]:
            nonlocal held, opened
            bands, docs, slots = (np.concatenate(x) for x in zip(*held, strict=True))
            first = np.r_[sorted_groups(bands), len(bands)]
            whole = len(first) - 1 if last else len(first) - 2
            links = []
            for k in range(whole):
                a, b = first[k], first[k + 1]
                if opened and opened[0] == bands[a]:
                    links += [(int(d), opened[1]) for d in docs[a:b]]
                elif b - a > 1:
                    if b - a > bucket:
                        links += [(int(d), int(docs[a])) for d in docs[a + 1 : b]]
                    else:
                        links += _tie(docs[a:b], slots[a:b], share)
            held = []
            if not last:
                a = first[-2]
                if len(bands) - a > bucket:  # it is larger than a task compares: tie it and remember its first
                    if not (opened and opened[0] == bands[a]):
                        opened = (int(bands[a]), int(docs[a]))
                    links += [(int(d), opened[1]) for d in docs[a:]]
                else:
                    held = [(bands[a:], docs[a:], slots[a:])]
            return [x for x, _ in links], [y for _, y in links]

        size = 0
        for batch in batches:
            width = len(batch.column("slots")[0].as_py()) if batch.num_rows else SLOTS
            slots = np.frombuffer(b"".join(batch.column("slots").to_pylist()), np.uint8).reshape(-1, width)
            held.append((batch.column("band").to_numpy(), batch.column("doc").to_numpy(), slots))
            size += batch.num_rows
            if size > 3 * bucket:
                a, b = flush(False)
                size = sum(len(h[0]) for h in held)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if held:
            a, b = flush(True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ordered = members.repartition("band").sortWithinPartitions("band", "doc")
    return ordered.mapInArrow(run, "a long, b long").where(F.col("a") != F.col("b")).dropDuplicates()


def exact_links(ids: np.ndarray, hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, likeness: float, first_block: int | None = None) -> list[tuple[int, int]]:
    """A forest with the same components as all pairs of bags at least ``likeness`` alike.

    owner: the position in ``ids`` of each (shingle, weight). A bag too much of which nobody shares is alike to none and is set
    aside at once. Each other one in turn, unless a class holds all that are left, is compared with every bag outside its class.
    ``first_block``: only pairs of which one is among so many first ids and the other is not.
    """
    n = len(ids)
    total = np.bincount(owner, weights, n)
    _, code, sharers = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = np.bincount(owner, weights * (sharers[code] > 1), n)
    live = shared >= likeness * total - 1e-9
    keep = live[owner]
    code, weights, owner = code[keep], weights[keep], owner[keep]
    begin = np.searchsorted(owner, np.arange(n + 1))
    order = np.argsort(code, kind="stable")
    by_code, code_begin = owner[order], np.searchsorted(code[order], np.arange(len(sharers) + 1))
    by_weight = weights[order]
    label, links = np.arange(n), []

    def compare(i: int) -> np.ndarray:
        own, w = code[begin[i] : begin[i + 1]], weights[begin[i] : begin[i + 1]]
        length = code_begin[own + 1] - code_begin[own]
        where = np.repeat(code_begin[own] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        overlap = np.bincount(by_code[where], np.minimum(by_weight[where], np.repeat(w, length)), n)
        near = live & (overlap >= likeness * (total + total[i] - overlap) - 1e-9)
        near[i] = False
        if first_block is not None:
            near &= (np.arange(n) < first_block) != (i < first_block)
        return np.flatnonzero(near)

    # bags that share most with the group come first: they join most of it at once
    popular = np.bincount(owner, weights * sharers[code], n) / np.maximum(total, 1)
    for i in np.argsort(-popular, kind="stable"):
        if not live[i]:
            continue
        if (label[live] == label[i]).all():
            break
        if (label == label[i]).sum() > 1 and not _open(label, live, i):
            continue
        for j in compare(i):
            if label[j] != label[i]:
                links.append((int(ids[max(i, j, key=lambda k: ids[k])]), int(ids[min(i, j, key=lambda k: ids[k])])))
                label[label == label[j]] = label[i]
    return links


def _open(label: np.ndarray, live: np.ndarray, i: int) -> bool:
    """Whether a live bag lies outside the class of i."""
    return bool((live & (label != label[i])).any())


def verified_links(documents: DataFrame, groups: DataFrame, likeness: float, block: int = BLOCK) -> DataFrame:
    """(a, b) links between documents of one coarse group, decided on their bags. ``groups(node, component)``."""
    ranked = groups.groupBy("component").agg(F.count("*").alias("members"))
    salted = groups.join(ranked, "component").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    placed = salted.withColumn("own", own).withColumn("cells", pairs).select(F.col("node").alias("doc_id"), "component", "own", "cells")

    def bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, column in slices(batch):
                data, ends = utf8(pc.utf8_lower(column))
                hashes, weights, owner = bags(data, ends)
                begin = np.searchsorted(owner, np.arange(len(column) + 1))
                wide = np.empty(len(hashes), [("h", "<u8"), ("w", "<u4")])
                wide["h"], wide["w"] = hashes, np.minimum(weights, 2**32 - 1)
                bag = [wide[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("component"), rows.column("own"), rows.column("cells"), pa.array(bag, pa.binary())], ["doc_id", "component", "own", "cells", "bag"])

    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(placed, "doc_id")
    bagged = kept.mapInArrow(bag_rows, "doc_id long, component long, own int, cells array<struct<i:int,j:int>>, bag binary")
    cells = bagged.select("doc_id", "component", "own", "bag", F.explode("cells").alias("cell")).select("doc_id", "component", "own", "bag", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"key": None, "rows": {}}

        def finish() -> list[tuple[int, int]]:
            key, rows = held["key"], held["rows"]
            if key is None or len(rows) < 2:
                return []
            ordered = sorted(rows, key=lambda d: (rows[d][0], d))
            bag = [np.frombuffer(rows[d][1], [("h", "<u8"), ("w", "<u4")]) for d in ordered]
            flat, owner = np.concatenate(bag), np.repeat(np.arange(len(bag)), [len(b) for b in bag])
            cross = sum(rows[d][0] == key[1] for d in ordered) if key[1] != key[2] else None
            return exact_links(np.array(ordered), flat["h"], flat["w"].astype(np.float64), owner, likeness, cross)

        for batch in batches:
            links: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in ("component", "i", "j", "own", "doc_id", "bag")]
            for c, i, j, own_block, d, b in zip(*columns, strict=True):
                if held["key"] != (c, i, j):
                    links += finish()
                    held.update(key=(c, i, j), rows={})
                held["rows"][d] = (own_block, b)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
        links = finish()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(decide, "a long, b long").dropDuplicates()


def near_duplicates(documents: DataFrame, *, likeness: float = 0.8) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and text_id (the least doc_id with the same words), a row per doc_id.

    Classes are the components of links between bags of five-word shingles at least ``likeness`` alike; letter case and ASCII
    white space don't count. A text of fewer words is one shingle. Texts without words (also null ones) are alike only
    to each other. A doc_id with several texts is one document: what is like any of them is of its class. Rows without doc_id are passed over, repeated rows count once, texts of any length are taken whole,
    an empty table gives an empty one, other columns are not read.
    """
    known = cut(signed(documents))
    ends = [F.min(F.struct("k1", "k2")).alias("one"), F.max(F.struct("k1", "k2")).alias("other")]
    if not known.groupBy("doc_id").agg(*ends).where("one <> other").limit(1).count():
        return _classes(documents, known, likeness)
    # numbers for each text of each doc_id, in order of doc_id
    order = ("doc_id", "k1", "k2")
    numbers = cut(known.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()))
    named = written(_with_keys(documents).join(numbers, [*order]).select(F.col("node").alias("doc_id"), "text"))
    whose = numbers.select("node", F.col("doc_id").alias("whose"))
    found = _classes(named, cut(signed(named)), likeness, whose)
    for name in ("doc_id", "class_id", "text_id"):
        found = found.withColumnRenamed(name, "node").join(whose, "node").drop("node").withColumnRenamed("whose", name)
    return found.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("text_id").alias("text_id"))


def _classes(documents: DataFrame, known: DataFrame, likeness: float, whose: DataFrame | None = None) -> DataFrame:
    """``near_duplicates`` where each doc_id has one text. ``whose(node, whose)``: documents (by doc_id) that are of one class whatever their texts."""
    texts = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("text_id"))
    kept = known.join(texts, ["k1", "k2"])
    members = kept.where(F.col("doc_id") == F.col("text_id")).select(F.explode("bands").alias("band"), F.col("doc_id").alias("doc"), "slots")
    groups = components(cut(coarse_links(members)))
    links = verified_links(documents, cut(groups), likeness)
    if whose is not None:
        own = kept.select(F.col("doc_id").alias("node"), "text_id").join(whose, "node")
        least = own.groupBy("whose").agg(F.min("text_id").alias("b"))
        links = links.union(own.join(least, "whose").select(F.col("text_id").alias("a"), "b"))
    classes = components(cut(links))
    found = kept.select("doc_id", "text_id").join(classes, F.col("text_id") == F.col("node"), "left")
    return found.groupBy("doc_id").agg(F.min(F.coalesce("component", "text_id")).alias("class_id"), F.min("text_id").alias("text_id"))
