"""Canonical exact digests.

A text's canonical form: compatibility normalisation, case folding, every run of white space one blank, none at the
ends. Its digest is 128 bits wide. Digests only put texts into buckets: inside a bucket the canonical
forms' bytes are compared (in a lossless packed form), and should two ever differ, all
texts of that bucket get a SHA-256 suffix, so equal fingerprints mean equal canonical texts. Edited texts are named with the same care: a digest
that stands for two canonical forms with different SHA-256, of texts or edited texts, is such a bucket too.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: Runs of documents in doc_id order for each shuffle partition.
RUNS = 4


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(form: bytes) -> bytes:
    return xxhash.xxh3_128_digest(form)


def digests(documents: DataFrame, hashing: Callable[[bytes], bytes] = digest) -> DataFrame:
    """doc_id and digest of every row of ``documents(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, column in slices(batch):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([hashing(canonical(t)) for t in column.to_pylist()], pa.binary())], ["doc_id", "digest"])

    return documents.mapInArrow(run, "doc_id long, digest binary")


def shared_digests(documents: DataFrame, hashing: Callable[[bytes], bytes] = digest) -> DataFrame:
    """doc_id of every row whose digest another row has. Buckets are counted in part before the shuffle, and a large one's side of the join can be split."""
    found = digests(documents, hashing)
    buckets = found.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    return found.join(buckets.hint("shuffle_hash"), "digest").select("doc_id")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of letters replaced by the first as many (or all) of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "n_chars long, edited_sha256 string, digest binary, edited_digest binary, sure binary, edited_sure binary, same_edited boolean, same_next boolean"


def _compare(text: str, following: str, hashing: Callable[[bytes], bytes]) -> tuple:
    changed = edited(text, following)
    raw = changed.encode()
    form, other, after = canonical(text), canonical(changed), canonical(following)
    return (len(text), hashlib.sha256(raw).hexdigest(), hashing(form), hashing(other), hashlib.sha256(form).digest(), hashlib.sha256(other).digest(), form == other, form == after)


def _in_runs(bounds: list[int], text: bool):
    """Rows with the number of their run: texts, packed (kind 1), or the mark that a document's digest is shared (kind 0)."""
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for rows, column in slices(batch) if text else [(batch, None)]:
                ids = rows.column("doc_id")
                part = np.where(ids.is_null(), len(edges) + 1, np.searchsorted(edges, ids.fill_null(0).to_numpy(), "right"))  # rows without doc_id are the last run
                packed = pa.array([pack(t.encode()) for t in column.to_pylist()], pa.binary()) if text else pa.nulls(rows.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), ids, pa.array(np.full(rows.num_rows, int(text), np.int32)), packed], ["run", "doc_id", "kind", "packed"])

    return run


def _stream(hashing: Callable[[bytes], bytes]):
    """Rows in order of run, doc_id and kind: each text is compared with the one after it in its run.

    kind 0 tells that the next text is in a shared bucket; kind 1 is a text. Out come results (kind 0), and for each
    run its first (kind 1) and last (kind 2) text, which are compared with other runs' later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        names = ["kind", "run", "doc_id", "packed", "form", *(f.split()[0] for f in RESULT.split(", "))]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.string(), *[pa.binary()] * 4, pa.bool_(), pa.bool_()]
        out: list[tuple] = []
        before: tuple | None = None
        marked: list[int | None] = []  # the doc_id marked last, which may be missing

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        blank = (None,) * 8

        def last(row: tuple) -> tuple:
            run, doc, packed, _, shared = row
            return (2, run, doc, packed, pack(canonical(unpack(packed).decode())) if shared else None, *blank)

        for batch in batches:
            for run, doc, kind, packed in zip(*(batch.column(c).to_pylist() for c in ("run", "doc_id", "kind", "packed")), strict=True):
                if kind == 0:
                    marked = [doc]
                    continue
                text = unpack(packed).decode()
                shared = marked == [doc]
                if before is not None and before[0] == run:
                    form = pack(canonical(before[3])) if before[4] else None
                    out.append((0, run, before[1], None, form, *_compare(before[3], text, hashing)))
                else:
                    if before is not None:
                        out.append(last(before))
                    out.append((1, run, doc, packed, None, *blank))
                before = (run, doc, packed, text, shared)
            if out:
                yield batch_of(out)
                out = []
        if before is not None:
            yield batch_of([last(before)])

    return run


def _pairs(hashing: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = [f.split()[0] for f in RESULT.split(", ")]
        for batch in batches:
            rows = [_compare(unpack(a).decode(), unpack(b).decode(), hashing) for a, b in zip(batch.column("packed").to_pylist(), batch.column("following").to_pylist(), strict=True)]
            types = [pa.int64(), pa.string(), *[pa.binary()] * 4, pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("form"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", "form", *names])

    return run


def fingerprints(documents: DataFrame, *, hashing: Callable[[bytes], bytes] = digest) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of ``documents(doc_id, text)``.

    The edited text has its last quarter replaced by the start of the next document's, in order of doc_id (the last is followed by the
    first; one alone by itself). An exact digest's likeness is 1 where the canonical texts are equal, else 0. A null text is empty.
    Rows that repeat a doc_id follow each other in order of their packed texts; rows without doc_id come last, as one run. Any doc_id is allowed,
    2**63 - 1 too. An empty table gives no rows; long texts are streamed whole. Other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    session = rows.sparkSession
    partitions = int(session.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, partitions * RUNS)
    bounds = sorted(set(min(int(b), 2**63 - 1) for b in rows.select("doc_id").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) or []))  # as many as runs
    schema = "run int, doc_id long, kind int, packed binary"
    ordered = shared_digests(rows, hashing).mapInArrow(_in_runs(bounds, False), schema).union(rows.mapInArrow(_in_runs(bounds, True), schema)).repartition("run").sortWithinPartitions("run", "doc_id", "kind", "packed")
    seen = cut(ordered.mapInArrow(_stream(hashing), f"kind int, run int, doc_id long, packed binary, form binary, {RESULT}"))
    # a run's last text is followed by the first of the next run that has one
    order = [r["run"] for r in seen.where("kind = 1").select("run").orderBy("run").collect()]  # as many as runs
    follow = session.createDataFrame([(a, b) for a, b in zip(order, order[1:] + order[:1], strict=True)], "run int, next_run int")
    firsts = seen.where("kind = 1").select(F.col("run").alias("next_run"), F.col("packed").alias("following"))
    edges = seen.where("kind = 2").select("run", "doc_id", "packed", "form").join(F.broadcast(follow), "run").join(firsts, "next_run").mapInArrow(_pairs(hashing), f"doc_id long, form binary, {RESULT}")
    results = cut(seen.where("kind = 0").drop("kind", "run", "packed").union(edges))
    clashes = cut(clashing(results))

    def name(found: DataFrame, wide: str, sure: str, out: str) -> DataFrame:
        plain = F.lower(F.hex(wide))
        if not clashing_any:
            return found.withColumn(out, plain)
        hit = clashes.select(F.col("digest").alias("_digest"))
        return found.join(hit, F.col(wide) == F.col("_digest"), "left").withColumn(out, F.when(F.col("_digest").isNull(), plain).otherwise(F.concat_ws("-", plain, F.lower(F.hex(sure))))).drop("_digest")

    clashing_any = clashes.limit(1).count() > 0
    named = name(name(results, "digest", "sure", "fingerprint"), "edited_digest", "edited_sure", "edited_fingerprint")
    return named.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        F.col("same_edited").cast("double").alias("near_edited"), F.col("same_next").cast("double").alias("near_next"),
    )


def clashing(results: DataFrame) -> DataFrame:
    """(digest) of buckets that hold different canonical forms: by their bytes among documents, by SHA-256 with edited texts too."""
    members = results.where(F.col("form").isNotNull()).select("digest", "doc_id", "form")
    firsts = members.groupBy("digest").agg(F.min_by("form", F.struct("doc_id", "form")).alias("first_form"))
    by_bytes = members.join(firsts, "digest").where(F.col("form") != F.col("first_form")).select("digest")
    both = results.select("digest", "sure").union(results.select(F.col("edited_digest").alias("digest"), F.col("edited_sure").alias("sure")))
    by_sum = both.groupBy("digest").agg(F.min("sure").alias("low"), F.max("sure").alias("high")).where(F.col("low") != F.col("high")).select("digest")
    return by_bytes.union(by_sum).distinct()
