"""Quality scores from compression.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text is
compressed in blocks under either dictionary, and what the two sizes differ by, for each byte of
text, says which kind it is like. A logistic curve over that difference and over the mean size
(text that repeats itself shrinks under any dictionary) turns it into a calibrated score.

Blocks keep the dictionaries' say the same in short and long texts: every byte is compressed, but
never with more than one block's own history.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, slices, utf8


@dataclass(frozen=True)
class QualityModel:
    """What scores a text: two dictionaries (empty: none) and the curve's weights. No score is surer than
    ``doubt``, half the share of training labels that the curve gets wrong, allows."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    block: int
    level: int
    doubt: float = 0.0


def training_rows(documents: DataFrame, labels: DataFrame, *, per_class: int, longest: int, folds: int, held_fold: int) -> list[tuple[int, str]]:
    """(quality, text) of a bounded sample: at most about ``per_class`` labelled texts of each class and of at
    most ``longest`` bytes each, taken by a hash of doc_id, so alike in every run. No row of the held-out fold."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_mod("doc_id", folds) != held_fold)).dropDuplicates(["doc_id", "quality"])
    sizes = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("quality") == 1, F.lit(per_class / max(sizes.get(1, 1), 1))).otherwise(F.lit(per_class / max(sizes.get(0, 1), 1)))
    chosen = F.broadcast(usable.where(draw < share).limit(3 * per_class))  # a proven bound: the limit
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= longest)).join(chosen, "doc_id")
    return [(r["quality"], r["text"]) for r in found.select("quality", "text", F.xxhash64("doc_id").alias("h")).orderBy("h", "text").limit(3 * per_class).collect()]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content) if content else None
    if data is not None:
        data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_dict_id=False, write_checksum=False)


def sizes_by_text(data: np.ndarray, ends: np.ndarray, pair: tuple, block: int) -> np.ndarray:
    """For each text its compressed size under the good and the bad dictionary."""
    out = np.zeros((len(ends) - 1, 2), np.int64)
    view = memoryview(np.ascontiguousarray(data))
    good, bad = (c.compress for c in pair)
    for i, (start, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        g = b = 0
        for at in range(start, end, block):
            piece = view[at : min(at + block, end)]
            g += len(good(piece))
            b += len(bad(piece))
        out[i] = g, b
    return out


def features(sizes: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The normalised difference, the mean rate, and their curvature; zeros for an empty text."""
    n = np.maximum(n_bytes, 1)
    difference, rate = (sizes[:, 1] - sizes[:, 0]) / n, (sizes[:, 0] + sizes[:, 1]) / (2 * n)
    difference, rate = np.clip(difference, -1, 1), np.minimum(rate, 1)
    short = 1 / np.sqrt(n)
    return np.c_[difference, rate, difference**2, rate**2, difference * rate, short, difference * short]


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Weights of a logistic curve (intercept first) by Newton's method, on standardised inputs."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, penalty = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slope = w[1:] / scale
    return (float(w[0] - slope @ mean), *map(float, slope))


def train(rows: list[tuple[int, str]], *, dictionary_bytes: int = 65_536, block: int = 2_048, level: int = 1) -> QualityModel:
    """Dictionaries from all rows; the curve from sizes under dictionaries that a row had no part in (two halves in turn)."""
    y = np.array([q for q, _ in rows], np.int64)
    raw = [t.encode() for _, t in rows]
    if len(set(y.tolist())) < 2:
        n1 = int(y.sum())
        odds = (n1 + 1) / (len(y) - n1 + 1)
        return QualityModel(b"", b"", (float(np.log(odds)), *[0.0] * 7), block, level)
    half = np.zeros(len(y), bool)
    for q in (0, 1):
        half[np.flatnonzero(y == q)[::2]] = True

    def build(mask: np.ndarray) -> tuple[bytes, bytes]:
        return tuple(dictionary([p for i in np.flatnonzero(mask & (y == q)) for p in (raw[i][a : a + block] for a in range(0, len(raw[i]), block))], dictionary_bytes) for q in (1, 0))

    x = np.zeros((len(y), 7))
    n_bytes = np.array([len(r) for r in raw])
    for mask in (half, ~half):
        pair = tuple(compressor(d, level) for d in build(~mask))
        own = [raw[i] for i in np.flatnonzero(mask)]
        ends = np.r_[0, np.cumsum([len(r) for r in own])].astype(np.int64)
        x[mask] = features(sizes_by_text(np.frombuffer(b"".join(own), np.uint8), ends, pair, block), n_bytes[mask])
    weights = fit_curve(x, y)
    wrong = int(((weights[0] + x @ np.array(weights[1:]) > 0) != (y == 1)).sum())
    return QualityModel(*build(np.ones(len(y), bool)), weights, block, level, (wrong + 1) / (len(y) + 2) / 2)


def score_quality(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.3, folds: int = 5, held_fold: int = 0, per_class: int = 1_500, longest: int = 32_768) -> DataFrame:
    """doc_id, held_out, score, predicted, n_bytes, good_bytes and bad_bytes of every row of ``documents(doc_id, text)``.

    ``labels(doc_id, quality)`` of the held-out fold are never learned from; labels that are null, neither 0 nor 1,
    or without a document are passed over, and a doc_id with both labels counts for both. If only one class
    is left, every text gets the smoothed share of good labels. A null text is scored as an empty
    one. Repeated rows give repeated results; no row is dropped; a row without doc_id is scored, not learned from, and not held out; texts of any
    length are scored whole; an empty table gives an empty one; other columns are not read. Training takes a bounded sample:
    ``per_class`` texts of each class, none longer than ``longest`` bytes (scored texts have no such bound).
    """
    model = _fitted(documents, labels, per_class, longest, folds, held_fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model.value)
        for batch in batches:
            for rows, column in slices(batch):
                scores, sizes, n_bytes = score(column)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores), pa.array(n_bytes), pa.array(sizes[:, 0]), pa.array(sizes[:, 1])], ["doc_id", "score", "n_bytes", "good_bytes", "bad_bytes"])

    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_bytes long, good_bytes long, bad_bytes long")
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_bytes", "good_bytes", "bad_bytes")


class Scorer:
    """Scores texts under a model; made once per task."""

    def __init__(self, model: QualityModel):
        self.model, self.pair = model, (compressor(model.good, model.level), compressor(model.bad, model.level))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = self.model
        data, ends = utf8(column)
        sizes, n_bytes = sizes_by_text(data, ends, self.pair, m.block), np.diff(ends)
        z = m.weights[0] + features(sizes, n_bytes) @ np.array(m.weights[1:])
        return m.doubt + (1 - 2 * m.doubt) / (1 + np.exp(-np.clip(z, -30, 30))), sizes, n_bytes


def _fitted(documents: DataFrame, labels: DataFrame, per_class: int, longest: int, folds: int, held_fold: int):
    rows = training_rows(documents, labels, per_class=per_class, longest=longest, folds=folds, held_fold=held_fold)
    return documents.sparkSession.sparkContext.broadcast(train(rows))  # bounded by dictionary_bytes


def keep_good(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.3, folds: int = 5, held_fold: int = 0, per_class: int = 1_500, longest: int = 32_768) -> DataFrame:
    """The rows of ``documents`` that ``score_quality`` predicts 1 for (a score equal to the threshold is kept), with all their columns, whatever their names.

    Null and empty texts are judged as empty ones, rows without doc_id and repeated rows like any others; no rows give none. Nothing is shuffled.
    """
    model = _fitted(documents, labels, per_class, longest, folds, held_fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model.value)
        for batch in batches:
            for rows, column in slices(batch):
                yield rows.filter(pa.array(score(column)[0] >= threshold))

    return documents.mapInArrow(run, documents.schema)
