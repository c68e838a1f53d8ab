"""Clipping of groups of any size about their mean or median, again and again until nothing more goes.

Groups of moderate size are sorted by value within a task, and all rounds of many groups run side by side on arrays: one shuffle, whatever the number of rounds. A larger group never meets in one
task. Its rows are sorted by range over all tasks and packed into blocks of neighbouring values, each with its count, sums and ends. Bounds leave a block whole, drop it or cut it; only values of blocks that are
cut, or hold the median, are looked at. A group's blocks, without their values, are followed through the rounds; a block that is cut but not open yet counts as evenly spread from there on, and all that
are cut on the way are asked for, with their neighbours. That is repeated with the asked ones open until no round had to guess: each time at least one more round is known, most often all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.checkpoints import settled, shared_folder
from .cells import CELL, HOT_ROWS
from .selection import sent

#: Most rows of a block.
BLOCK = 4096


def clip_groups(rows: DataFrame, sigma: float, rounds: int = 100, keys: list[str] = CELL, high_sigma: float | None = None, centre: str = "mean", hot: int = HOT_ROWS, block: int = BLOCK) -> DataFrame:
    """(keys, low, high), settled: the bounds that clipping ends with, ``sigma`` spreads below the centre and ``high_sigma`` (the same if not given) above it; values strictly between them are left.

    centre: mean, or median. Groups beyond ``hot`` rows are clipped by blocks. Null and non-finite values don't count, groups without others are absent, and so are groups with a null key, which no join on keys finds.
    ``rows`` are read several times: settle them if they are dear to make."""
    if centre not in ("mean", "median"):
        raise ValueError(f"centre must be mean or median, not {centre}")
    rule = (sigma, sigma if high_sigma is None else high_sigma, rounds, centre == "median")
    x = F.col("value").cast("double")
    rows = rows.select(*keys, x.alias("value")).where((x > float("-inf")) & (x < float("inf"))).where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    large = settled(rows.groupBy(*keys).agg(F.count("*").alias("_size")).where(F.col("_size") > hot).select(*keys))
    if not large.limit(1).count():
        return settled(_by_group(rows, keys, rule))
    small = _by_group(rows.join(sent(large), keys, "left_anti"), keys, rule)
    return settled(small.unionByName(_by_blocks(rows.join(sent(large), keys, "left_semi"), keys, rule, block)))


def within(rows: DataFrame, bounds: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """The rows strictly between the settled bounds of their group."""
    return rows.join(sent(bounds), keys).where((F.col("value") > F.col("low")) & (F.col("value") < F.col("high")))


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row of a sorted table has other keys than the row before."""
    changed = np.arange(len(table)) == 0
    for k in keys:
        x = table.column(k).to_numpy()
        changed[1:] |= (x[1:] != x[:-1]) & ~((x[1:] != x[1:]) & (x[:-1] != x[:-1]))  # NaN is a key like others
    return changed


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by keys, as tables of whole groups: about a batch, or one group if that is larger."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        before = [held[-1].slice(len(held[-1]) - 1)] if held else []
        starts = np.flatnonzero(_changes(pa.Table.from_batches([*before, batch]), keys)[len(before) :])
        if held and not len(starts):
            held.append(batch)
            continue
        cut = int(starts[-1])  # where the group begins that may go on
        done = [*held, batch.slice(0, cut)] if cut else held
        held = [batch.slice(cut)]
        if done:
            yield pa.Table.from_batches(done)
    if held:
        yield pa.Table.from_batches(held)


def _clipped(groups: np.ndarray, values: np.ndarray, n: int, rule: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of groups 0 to ``n`` - 1, of rows sorted by group and value. Sums run through the values in order, so they don't depend on how rows were dealt out."""
    below, above, rounds, median = rule
    low, high, before = np.full(n, -np.inf), np.full(n, np.inf), np.full(n, -1)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            size = np.bincount(groups, minlength=n)
            goes = (size != before) & (size >= 2)
            if not goes.any():
                break
            before, on = size, goes[groups]
            groups, values, size = groups[on], values[on], np.where(goes, size, 0)
            if median:
                start, c = (np.cumsum(size) - size)[goes], np.zeros(n)
                c[goes] = values[start + (size[goes] - 1) // 2] / 2 + values[start + size[goes] // 2] / 2
            else:
                c = np.bincount(groups, values, n) / size
            spread = np.sqrt(np.maximum(np.bincount(groups, values * values, n) - size * c * c, 0) / (size - 1))
            low = np.where(goes, np.maximum(low, c - below * spread), low)  # no number lies above a bound that is none
            high = np.where(goes, np.fmin(high, c + above * spread), high)
            kept = (values > low[groups]) & (values < high[groups])
            groups, values = groups[kept], values[kept]
    return low, high


def _by_group(rows: DataFrame, keys: list[str], rule: tuple) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, keys):
            first = _changes(table, keys)
            low, high = _clipped(np.cumsum(first) - 1, table.column("value").to_numpy(), int(first.sum()), rule)
            found = table.select(keys).take(pa.array(np.flatnonzero(first)))
            yield from found.append_column("low", pa.array(low)).append_column("high", pa.array(high)).combine_chunks().to_batches()

    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    return rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "value").mapInArrow(run, schema)


def _packing(keys: list[str], block: int) -> Callable:
    """Rows sorted by keys and value to blocks; ``_b`` names a block by task and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column("value").to_numpy()
            at = np.flatnonzero(_changes(pa.Table.from_batches([batch]), keys))
            ends = np.r_[at[1:], len(x)]
            starts = np.concatenate([np.arange(a, b, block) for a, b in zip(at, ends, strict=True)])
            parts = np.split(x, starts[1:])
            columns = {
                "_b": pa.array(number + np.arange(len(parts))), "_low": pa.array([float(v[0]) for v in parts]), "_high": pa.array([float(v[-1]) for v in parts]), "_n": pa.array([len(v) for v in parts], pa.int64()),
                "_s": pa.array([float(v.sum()) for v in parts]), "_q": pa.array([float((v * v).sum()) for v in parts]), "_v": pa.array([v.tobytes() for v in parts], pa.binary()),
            }
            number += len(parts)
            found = batch.select(keys).take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([*found.columns, *columns.values()], [*keys, *columns])

    return run


def _followed(low_ends: np.ndarray, high_ends: np.ndarray, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, values: list[np.ndarray | None], rule: tuple) -> tuple[float, float, set[int] | None]:
    """(low, high, asked) of a group in blocks in order of their values, of which ``values`` has the open ones: the bounds and none if no round had to guess, else the blocks to open."""
    below, above, rounds, median = rule
    low, high, before, asked, known = -np.inf, np.inf, -1, set(), True

    def of(b: int) -> np.ndarray:
        nonlocal known
        asked.add(b)
        if values[b] is None:
            known = False
            return np.linspace(low_ends[b], high_ends[b], n[b])
        return values[b]

    with np.errstate(all="ignore"):
        for _ in range(rounds):
            whole = (low_ends > low) & (high_ends < high)
            inside, total, square, cut = np.where(whole, n, 0), sums[whole].sum(), squares[whole].sum(), {}
            for b in np.flatnonzero(~whole & (high_ends > low) & (low_ends < high)).tolist():
                v = of(b)
                cut[b] = v = v[(v > low) & (v < high)]
                inside[b], total, square = len(v), total + v.sum(), square + (v * v).sum()
            size = int(inside.sum())
            if size == before or size < 2:
                break
            before, c = size, total / size
            if median:
                upto, pair = np.cumsum(inside), []
                for rank in ((size - 1) // 2, size // 2):
                    b = int(np.searchsorted(upto, rank, "right"))
                    pair.append((cut[b] if b in cut else of(b))[rank - (upto[b] - inside[b])])
                c = pair[0] / 2 + pair[1] / 2
            spread = np.sqrt(np.maximum(square - size * c * c, 0) / (size - 1))
            low, high = np.maximum(low, c - below * spread), np.fmin(high, c + above * spread)
    if known:
        return low, high, None
    near = {b + k for b in (0, len(n) - 1, *asked) for k in (-1, 0, 1)}
    return low, high, {b for b in near if 0 <= b < len(n)}


def _following(keys: list[str], rule: tuple) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, keys):
            starts = np.flatnonzero(_changes(table, keys))
            columns = [table.column(c).to_numpy() for c in ("_low", "_high", "_n", "_s", "_q")]
            names, packed, found = table.column("_b").to_numpy(), table.column("_v"), []
            for a, b in zip(starts, np.r_[starts[1:], len(table)], strict=True):
                opened = [None if v is None else np.frombuffer(v) for v in packed.slice(a, b - a).to_pylist()]
                low, high, asked = _followed(*(x[a:b] for x in columns), opened, rule)
                found.append((float(low), float(high), None if asked is None else names[a + np.array(sorted(asked))].tolist()))
            low, high, asked = zip(*found, strict=True)
            out = table.select(keys).take(pa.array(starts))
            out = out.append_column("low", pa.array(low)).append_column("high", pa.array(high)).append_column("asked", pa.array(asked, pa.list_(pa.int64())))
            yield from out.combine_chunks().to_batches()

    return run


def _by_blocks(rows: DataFrame, keys: list[str], rule: tuple, block: int) -> DataFrame:
    fields, double, long = rows.select(*keys).schema.fields, T.DoubleType(), T.LongType()
    kinds = {"_b": long, "_low": double, "_high": double, "_n": long, "_s": double, "_q": double, "_v": T.BinaryType()}
    packed = T.StructType([*fields, *(T.StructField(k, t) for k, t in kinds.items())])
    result = T.StructType([*fields, T.StructField("low", double), T.StructField("high", double), T.StructField("asked", T.ArrayType(long))])
    # equal values are dealt out by where they come from, so that no value fills a task
    ranged = rows.withColumn("_from", F.spark_partition_id()).repartitionByRange(*[F.col(k) for k in (*keys, "value", "_from")]).drop("_from").sortWithinPartitions(*keys, "value")
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    ranged.mapInArrow(_packing(keys, block), packed).write.parquet(folder)
    blocks = spark.read.schema(packed).parquet(folder)
    given, ended = blocks.withColumn("_v", F.lit(None).cast("binary")), []
    while True:
        dealt = given.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "_low", "_high")
        found = settled(dealt.mapInArrow(_following(keys, rule), result))
        ended.append(found.where(F.col("asked").isNull()).select(*keys, "low", "high"))
        asking = found.where(F.col("asked").isNotNull())
        if not asking.limit(1).count():
            break
        opened = asking.select(F.explode("asked").alias("_b"), F.lit(True).alias("_open"))
        given = blocks.join(sent(asking.select(*keys)), keys, "left_semi").join(sent(opened), "_b", "left").withColumn("_v", F.when(F.col("_open"), F.col("_v"))).drop("_open")
    return reduce(DataFrame.unionByName, ended)
