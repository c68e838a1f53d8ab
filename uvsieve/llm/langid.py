"""Language identification by error-correcting output codes.

Every language gets a codeword. For each bit a binary classifier over hashed byte n-grams tells
the languages whose codeword has the bit set from the others. A text's margins are compared with
every codeword; each bit's loss counts by how well that bit does on the training rows, and the
codeword of least loss wins. Where the second is close behind, the row is marked ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, slices, sorted_groups, utf8

BUCKET_BITS = 16
LETTER = regex.compile(r"\p{L}")
#: Byte classes: letters in lower case, bytes beyond ASCII as they are, all else one blank.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def codewords(n: int, *, bits_per_class: int = 12, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 for each class. Up to six classes: every way to part them in two; beyond,
    seeded random columns that part them, with distinct rows far from each other."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        columns = [[1] + [1 if m >> i & 1 else -1 for i in range(n - 1)] for m in range(2 ** (n - 1) - 1)]
        return np.array(columns, float).T
    draw = np.random.default_rng(seed)
    width = int(np.ceil(bits_per_class * np.log2(n)))
    best, far = None, -1
    for _ in range(64):
        code = draw.choice([-1.0, 1.0], (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * width).min()
        if apart > far:
            best, far = code, apart
    return best


def grams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed 3- and 4-byte grams that begin at each byte (two per byte), and where each text's begin.

    A gram that would run over its text's end is taken over blanks."""
    folded = np.r_[FOLD[data], np.full(4, 32, np.uint32)]
    n = len(data)
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(n)
    b = [folded[k : k + n] if k == 0 else np.where(left > k, folded[k : k + n], np.uint32(32)) for k in range(4)]
    three = (b[0] << np.uint32(16)) | (b[1] << np.uint32(8)) | b[2]
    four = (three * np.uint32(0x01000193)) ^ (b[3] * np.uint32(0x9E3779B1))
    shift = np.uint32(32 - BUCKET_BITS)
    out = np.empty((n, 2), np.uint32)
    out[:, 0] = (three * np.uint32(0x9E3779B1)) >> shift
    out[:, 1] = (four * np.uint32(0x85EBCA6B)) >> shift
    return out, ends


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray
    sharpness: float


def margins(data: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per text and bit: the summed log odds of its grams over the root of how many there are."""
    buckets, _ = grams(data, ends)
    sums = np.zeros((len(ends) - 1, weights.shape[1]), np.float64)
    full = np.flatnonzero(np.diff(ends) > 0)
    if len(full):
        step = 1 << 18
        carry = weights[buckets[:step, 0]] + weights[buckets[:step, 1]] if len(buckets) <= step else None
        if carry is not None:
            sums[full] = np.add.reduceat(carry, ends[:-1][full], axis=0, dtype=np.float64)
        else:
            owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            for at in range(0, len(buckets), step):
                part, own = buckets[at : at + step], owner[at : at + step]
                first = sorted_groups(own)
                sums[own[first]] += np.add.reduceat(weights[part[:, 0]] + weights[part[:, 1]], first, axis=0, dtype=np.float64)
    return sums / np.sqrt(np.maximum(np.diff(ends), 1))[:, None]


def decode(m: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The winner of each row, its share of belief, and its lead over the second."""
    loss = np.logaddexp(0, -m[:, None, :] * model.code[None, :, :]) @ model.bit_weights
    belief = np.exp(-(loss - loss.min(1, keepdims=True)) * model.sharpness)
    belief /= belief.sum(1, keepdims=True)
    ranked = np.sort(belief, axis=1)
    lead = ranked[:, -1] - (ranked[:, -2] if belief.shape[1] > 1 else 0)
    return belief.argmax(1), ranked[:, -1], lead


def learn(rows: DataFrame, per_language: int, seed: int = 0) -> LanguageModel:
    """From ``rows(doc_id, text, lang)``, about ``per_language`` of each language taken by a hash of doc_id."""
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.ones((0, 1)), np.zeros((1 << BUCKET_BITS, 1), np.float32), np.ones(1), 1.0)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, per_language / sizes[lang])))])
    number = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5 + seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < F.element_at(share, F.col("lang"))).select(F.element_at(number, F.col("lang")).alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for part, column in slices(batch):
                data, ends = utf8(column)
                owner = np.repeat(part.column("lang").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(ends))
                buckets, _ = grams(data, ends)
                for k in (0, 1):
                    total += np.bincount(owner << BUCKET_BITS | buckets[:, k], minlength=total.size).reshape(total.shape)
        lang, gram = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(gram, pa.int32()), pa.array(total[lang, gram])], ["lang", "gram", "n"])

    found = sample.mapInArrow(count, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets rows at most
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    counts[found["lang"], found["gram"]] = found["n"]
    chance = (counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * counts.shape[1])
    code = codewords(len(languages))
    weights = np.zeros((counts.shape[1], code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        if len(languages) > 1:
            weights[:, b] = np.log(chance[code[:, b] > 0].mean(0)) - np.log(chance[code[:, b] < 0].mean(0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in slices(batch):
                m = margins(*utf8(column), weights)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(m.tolist(), pa.list_(pa.float64()))], ["lang", "m"])

    check = [(r["lang"], r["m"]) for r in sample.mapInArrow(measure, "lang int, m array<double>").limit(2 * per_language * len(languages)).collect()]
    y, m = np.array([c[0] for c in check], int), np.array([c[1] for c in check], float).reshape(len(check), -1)
    right = (np.sign(m) == code[y]).mean(0) if len(check) else np.full(code.shape[1], 0.5)
    bit_weights = np.clip(np.log((right + 1e-3) / (1 - right + 1e-3)), 0.05, None)
    bit_weights /= bit_weights.sum()

    def surprise(sharpness: float) -> float:
        loss = np.logaddexp(0, -m[:, None, :] * code[None, :, :]) @ bit_weights * sharpness
        return float((loss[np.arange(len(y)), y] + np.log(np.exp(-loss).sum(1))).mean())

    sharpness = min((0.5, 1.0, 2.0, 4.0, 8.0), key=surprise) if len(check) else 1.0
    return LanguageModel(languages, code, weights, bit_weights, sharpness)


def identify_language(documents: DataFrame, *, folds: int = 3, held_fold: int = 1, per_language: int = 2_000, clear_lead: float = 0.2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, runner-up lead of every row of ``documents(doc_id, text, lang)``.

    It learns from rows outside the held-out fold that have text and lang: a bounded sample of about
    ``per_language`` of each, taken by a hash. ``lang_pred`` is ``und``, with score 0 and ambiguous, where the text is null or
    has no letter, or where nothing could be learned. Ties go to the language first in order.
    Repeated rows give repeated results; a row without doc_id is judged, not learned from, and not held out; texts of any length are read whole;
    an empty table gives an empty one; other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    usable = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.coalesce(crc_mod("doc_id", folds) != held_fold, F.lit(False)))
    model = rows.sparkSession.sparkContext.broadcast(learn(usable, per_language))  # bounded by buckets x bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part, column in slices(batch):
                lettered = np.array([LETTER.search(t) is not None for t in column.to_pylist()], bool) & bool(m.languages)
                if m.languages:
                    winner, score, lead = decode(margins(*utf8(column), m.weights), m)
                else:
                    winner, score, lead = np.zeros((3, len(column)))
                names = [m.languages[int(w)] if ok else "und" for w, ok in zip(winner, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(np.where(lettered, lead, 0.0)), pa.array(~lettered | (lead < clear_lead))],
                    ["doc_id", "lang_pred", "score", "lead", "ambiguous"],
                )

    found = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, lead double, ambiguous boolean")
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held_fold, F.lit(False)).alias("held_out"), "lang_pred", "score", "lead", "ambiguous")
