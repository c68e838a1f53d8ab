"""Vector codes: every vector becomes one byte per part, the number of the nearest entry in that part's codebook.

Codebooks are refined in rounds of assignment and averaging, all in whole numbers, so that the result is exact and the same on any cluster. Most
distances are never computed. Entries are in groups; a vector keeps, for each group, a lower bound on its distance to the group's entries (but for the one that it is assigned to) and the round
in which the bound was taken. All rounds' codebooks are kept, so a later round lowers a bound by how far the group's entries have moved since that round, start to end: the norm of the sum of an entry's steps, which is never more than the
sum of the steps' norms. Only groups whose bound does not exceed the distance to the vector's own entry are scanned again, exactly.

Vectors stay where they are: a round is a pass over the table that the round before wrote, and sums of 256 entries travel. The codebooks have a fixed size, whatever the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written_at

#: Components up to this size have exact distances in doubles (of parts up to 1,024 wide); others are computed in whole numbers of any length.
EXACT = 1 << 20
#: Slack for roots and differences of bounds in floating point; it costs scans, never results.
SLACK = 1e-9
ROWS = "vec_id long, label long, vector array<long>"
STATE = ROWS + ", code binary, bounds binary, stamps binary, error long"
#: Rows of one numpy step.
STEP = 4096


@dataclass
class Codebooks:
    """All rounds' codebooks, [round][part, entry, place] in whole numbers."""

    history: list[np.ndarray]
    groups: int = 16
    scanned: int = field(default=0, compare=False)  # distances computed, for tests and tuning

    @property
    def last(self) -> np.ndarray:
        return self.history[-1]

    def digest(self) -> str:
        """The SHA-256 of all last entries' components by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.last.reshape(-1).tolist())).encode()).hexdigest()

    def prepare(self) -> Scanner:
        return Scanner(self)


class Scanner:
    """Assigns vectors under the last codebooks, with the bounds that they bring along."""

    def __init__(self, books: Codebooks):
        self.books, self.now = books, len(books.history) - 1
        self.parts, self.entries, self.width = books.last.shape
        self.size = -(-self.entries // books.groups)
        self.starts = list(range(0, self.entries, self.size))
        self.whole = [b for b in books.last]
        self.plain = bool(_within(books.last, EXACT).all()) and self.width <= 1024
        if self.plain:
            self.entry = books.last.astype(np.float64)
            self.square = (self.entry**2).sum(2)
        # how far each group has moved since each round, at most
        moved = np.stack([_norms(books.last - old) for old in books.history]) * (1 + SLACK)
        self.moved = np.maximum.reduceat(moved, self.starts, axis=2)  # round, part, group

    def assign(self, vectors: np.ndarray, code: np.ndarray, bounds: np.ndarray, stamps: np.ndarray) -> list[int]:
        """Sets code[row, part], bounds and stamps[row, part, group] of vectors[row, part, place], and gives the sums of squared distances."""
        small = _within(vectors, EXACT).all(axis=(1, 2)) if self.plain else np.zeros(len(vectors), bool)
        errors = np.zeros(len(vectors), object)
        rows = np.flatnonzero(small)
        if len(rows):
            own = [x[rows] for x in (code, bounds, stamps)]
            errors[rows] = sum(self._part(p, vectors[rows, p].astype(np.float64), *(x[:, p] for x in own)) for p in range(self.parts)).astype(np.int64).tolist()
            code[rows], bounds[rows], stamps[rows] = own
        for row in np.flatnonzero(~small).tolist():  # far out: whole numbers of any length, no bounds
            total = 0
            for p in range(self.parts):
                apart = ((self.whole[p].astype(object) - vectors[row, p].astype(object)[None, :]) ** 2).sum(1)
                code[row, p] = best = min(range(self.entries), key=lambda e: (apart[e], e))
                total += apart[best]
            bounds[row] = -np.inf
            errors[row] = int(total)
        return errors.tolist()

    def _part(self, p: int, x: np.ndarray, code: np.ndarray, bounds: np.ndarray, stamps: np.ndarray) -> np.ndarray:
        entry, square = self.entry[p], self.square[p]
        n, groups, every = len(x), len(self.starts), np.arange(len(x))
        xx = (x**2).sum(1)
        own = code.astype(np.int64)
        nearest = ((x - entry[own]) ** 2).sum(1)
        bound = bounds - self.moved[:, p][stamps, np.arange(groups)[None, :]]
        scan = ~(np.sqrt(nearest)[:, None] * (1 + SLACK) < bound)
        best = own.copy()
        least, second, where = np.full((n, groups), np.inf), np.full((n, groups), np.inf), np.full((n, groups), -1)

        def look(g: int, rows: np.ndarray) -> None:
            a = self.starts[g]
            b = min(a + self.size, self.entries)
            apart = xx[rows, None] - 2 * (x[rows] @ entry[a:b].T) + square[a:b]
            self.books.scanned += apart.size
            at = apart.argmin(1)
            least[rows, g], where[rows, g] = apart[np.arange(len(rows)), at], a + at
            apart[np.arange(len(rows)), at] = np.inf
            second[rows, g] = apart.min(1)

        for g in range(groups):
            rows = np.flatnonzero(scan[:, g])
            if len(rows):
                look(g, rows)
                d, e = least[rows, g], where[rows, g]
                better = (d < nearest[rows]) | ((d == nearest[rows]) & (e < best[rows]))
                nearest[rows[better]], best[rows[better]] = d[better], e[better]
        # the bound of the group that a vector has left is to cover the entry that it had
        left = own // self.size
        gone = (best != own) & ~scan[every, left]
        for g in np.unique(left[gone]).tolist():
            look(g, np.flatnonzero(gone & (left == g)))
        scan[every[gone], left[gone]] = True
        found = np.sqrt(np.where(where == best[:, None], second, least)) * (1 - SLACK)
        fresh = np.nextafter(found.astype(np.float32), np.float32(-np.inf))
        code[:] = best
        bounds[scan], stamps[scan] = fresh[scan], self.now
        return nearest


def _within(x: np.ndarray, limit: int) -> np.ndarray:
    return (x >= -limit) & (x <= limit)


def _norms(steps: np.ndarray) -> np.ndarray:
    return np.sqrt((steps.astype(np.float64) ** 2).sum(-1))


def integers(vectors: DataFrame, column: str = "embedding", scale: int = 1024, parts: int = 4) -> DataFrame:
    """(vec_id, label, vector) of rows whose vector has no hole and no number that isn't finite: floor(scale * x) of its components.

    Vectors without components, or with a number of them that isn't a multiple of ``parts``, go as well. Components beyond a long become the longest one."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    kept = vectors.where(x.isNotNull() & finite & (F.size(x) > 0) & (F.size(x) % parts == 0))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vector"))


def _cut(column: pa.Array, parts: int) -> np.ndarray:
    """vectors[row, part, place] of an Arrow list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), parts, -1)


def _bytes(column: pa.Array, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape).copy()


def _packed(array: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in array], pa.binary())


def assigned(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` with their codes under the last codebooks, new bounds and stamps, and ``error``, the sum of squared distances (null where it doesn't fit a long). Rows with no
    codes yet are scanned whole."""
    known = "code" in rows.columns
    sent = rows.sparkSession.sparkContext.broadcast(books)  # of fixed size
    longest = 2**63 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value.prepare()
        parts, groups = scanner.parts, len(scanner.starts)
        for whole in batches:
            for at in range(0, len(whole), STEP):
                batch = whole.slice(at, STEP)
                n = len(batch)
                if known:
                    code, bounds, stamps = _bytes(batch.column("code"), np.uint8, parts), _bytes(batch.column("bounds"), np.float32, parts, groups), _bytes(batch.column("stamps"), np.uint8, parts, groups)
                else:
                    code, bounds, stamps = np.zeros((n, parts), np.uint8), np.full((n, parts, groups), -np.inf, np.float32), np.zeros((n, parts, groups), np.uint8)
                errors = scanner.assign(_cut(batch.column("vector"), parts), code, bounds, stamps)
                fits = pa.array([e if e <= longest else None for e in errors], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("vector"), _packed(code), _packed(bounds), _packed(stamps), fits], [c.split(" ")[0] for c in STATE.split(", ")])

    return rows.mapInArrow(run, STATE)


#: Sums travel in two halves, so that they fit longs whatever the components.
HALF = 1 << 40


def averaged(rows: DataFrame, books: Codebooks) -> np.ndarray:
    """The next codebooks: the floor of the mean of each entry's parts; unused entries stay. Each task sends one number for each place of each entry; so many sums come back."""
    parts, entries, width = books.last.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), object), np.zeros(parts * entries, np.int64)
        for whole in batches:
            for at in range(0, len(whole), STEP):
                batch = whole.slice(at, STEP)
                vectors = _cut(batch.column("vector"), parts)
                slot = _bytes(batch.column("code"), np.uint8, parts).astype(np.int64) + np.arange(parts) * entries
                count += np.bincount(slot.reshape(-1), minlength=len(count))
                if _within(vectors, 1 << 40).all():  # sums of a step fit
                    sums = np.zeros((parts * entries, width), np.int64)
                    np.add.at(sums, slot.reshape(-1), vectors.reshape(-1, width))
                    total += sums
                else:
                    np.add.at(total, slot.reshape(-1), vectors.reshape(-1, width).astype(object))
        used = np.flatnonzero(count)
        flat = total[used].reshape(-1)
        high = flat // HALF
        low = flat - high * HALF
        arrays = [np.repeat(used, width), np.tile(np.arange(width), len(used)), np.repeat(count[used], width)]
        yield pa.RecordBatch.from_arrays([*(pa.array(a, pa.int64()) for a in arrays), pa.array(high.tolist(), pa.int64()), pa.array(low.tolist(), pa.int64())], ["slot", "place", "n", "high", "low"])

    sums = rows.select("vector", "code").mapInArrow(run, "slot long, place long, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    new = books.last.copy().reshape(parts * entries, width)
    for slot, place, n, high, low in sums.groupBy("slot", "place").agg(F.sum("n").alias("n"), wide("high"), wide("low")).collect():  # as many as the codebooks have numbers
        new[slot, place] = (int(high) * HALF + int(low)) // n
    return new.reshape(parts, entries, width)


def first_entries(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The codebooks of the ``entries`` least rows in order of vec_id (missing ones last) and vector, of one length; None if there are no rows."""
    order = (F.col("vec_id").asc_nulls_last(), F.col("vector"))
    first = rows.orderBy(*order).limit(1).select(F.size("vector").alias("n")).first()
    if first is None:
        return None
    least = rows.where(F.size("vector") == first["n"]).orderBy(*order).limit(entries).select("vector").collect()  # bounded by ``entries``
    return Codebooks([np.array([r["vector"] for r in least], np.int64).reshape(len(least), parts, -1).transpose(1, 0, 2).copy()])


def compress(vectors: DataFrame, *, column: str = "embedding", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, vector, code, error) of ``vectors(vec_id, embedding, label)``, and the codebooks that ``rounds`` rounds end with.

    ``code`` has a byte for each part. Vectors that are null, have holes or numbers that aren't finite, or another length than the first one in order of vec_id are left
    out; so are lengths that ``parts`` doesn't divide. A missing vec_id stands behind all others; repeated rows have equal codes, and each counts. Fewer rows than ``entries``
    make fewer entries. Equal entries: the lower number is taken. An empty table gives an empty one and no codebooks.
    Each round writes one table to the shared folder and discards the one before; a lost task is run again from the table that it read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte, so 1 to 256 entries")
    table, path = written_at(integers(vectors, column, scale, parts))
    books = first_entries(table, parts, entries)
    if books is None:
        return table.selectExpr("*", "cast(null AS binary) AS code", "cast(null AS long) AS error"), None
    table = table.where(F.size("vector") == parts * books.last.shape[2])
    for k in range(rounds + 1):
        table, new = written_at(assigned(table, books))
        discard(table.sparkSession, path)
        path = new
        if k < rounds:
            books.history.append(averaged(table, books))
    return table.select("vec_id", "label", "vector", "code", "error"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the errors summed over all rows of an equal label, those without one together (null if the sum doesn't fit a long)."""
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def expand(coded: DataFrame, books: Codebooks, scale: int = 1024) -> DataFrame:
    """(vec_id, embedding): the vectors that codes stand for, at the middle of their steps."""
    flat = (books.last.astype(np.float64) + 0.5) / scale
    sent = coded.sparkSession.sparkContext.broadcast(flat)  # of fixed size
    parts = len(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _bytes(batch.column("code"), np.uint8, parts)
            found = sent.value[np.arange(parts)[None, :], code].reshape(len(batch), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * found.shape[1], pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], ["vec_id", "embedding"])

    return coded.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")
