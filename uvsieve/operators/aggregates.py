"""A user's own aggregate of cells, or of any groups, as three functions on arrays.

``partial`` turns the rows of many groups into a state of fixed width for each, ``merge`` joins states, and ``finish`` makes a number of one. States are made where the rows are and
only states are shuffled, so a group may hold any share of the rows; how rows are dealt out doesn't matter as long as ``merge`` is associative.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups whose states a task holds before it sends them on.
HELD = 50_000


class GroupAggregate(Protocol):
    """columns: the columns that ``partial`` takes. ``groups`` numbers each row's group, from 0 to ``n`` - 1. States are a row of doubles per group."""

    columns: tuple[str, ...]

    def partial(self, groups: np.ndarray, n: int, *columns: np.ndarray) -> np.ndarray: ...

    def merge(self, groups: np.ndarray, n: int, states: np.ndarray) -> np.ndarray: ...

    def finish(self, states: np.ndarray) -> np.ndarray: ...


class Sums:
    """States that are merged by adding them."""

    def merge(self, groups: np.ndarray, n: int, states: np.ndarray) -> np.ndarray:
        out = np.zeros((n, states.shape[1]))
        np.add.at(out, groups, states)
        return out


class TrimmedMean(Sums):
    """The mean of the values from ``low`` to ``high``, columns that come with each row."""

    columns = ("value", "low", "high")

    def partial(self, groups: np.ndarray, n: int, *columns: np.ndarray) -> np.ndarray:
        value, low, high = columns
        kept = (value >= low) & (value <= high)
        return np.c_[np.bincount(groups[kept], value[kept], n), np.bincount(groups[kept], minlength=n)]

    def finish(self, states: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return states[:, 0] / states[:, 1]


def _numbered(keys: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
    """Each row's group, and the keys of each group; missing keys are a group like others."""
    groups = keys.groupby(list(keys.columns), dropna=False, sort=False).ngroup().to_numpy()
    _, first = np.unique(groups, return_index=True)
    return groups, keys.iloc[first].reset_index(drop=True)


def aggregate(rows: DataFrame, keys: list[str], function: GroupAggregate, name: str, held: int = HELD) -> DataFrame:
    """(keys, name): ``function`` of each group. Keys may be of any type that pandas groups; rows with nulls in the function's columns are passed over."""
    kinds = [f for f in rows.select(*keys).schema.fields]
    columns = list(function.columns)
    state = T.StructType([*kinds, T.StructField("_state", T.ArrayType(T.DoubleType()))])
    result = T.StructType([*kinds, T.StructField(name, T.DoubleType())])
    arrow_keys = [n.name for n in kinds]

    def lists(states: np.ndarray) -> pa.Array:
        width = states.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(states) + 1) * width, pa.int32()), pa.array(states.reshape(-1)))

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_states, schema = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(held_keys[k], schema.field(k).type, from_pandas=True) for k in arrow_keys), lists(held_states)], [*arrow_keys, "_state"])

        for batch in batches:
            schema = batch.schema
            frame = batch.select(arrow_keys).to_pandas()
            groups, own = _numbered(frame)
            states = function.partial(groups, len(own), *(batch.column(c).to_numpy(zero_copy_only=False) for c in columns))
            if held_keys is not None:
                both = pd.concat([held_keys, own], ignore_index=True)
                groups, own = _numbered(both)
                states = function.merge(groups, len(own), np.concatenate([held_states, states]))
            held_keys, held_states = own, states
            if len(held_keys) > held:
                yield out()
                held_keys = held_states = None
        if held_keys is not None and len(held_keys):
            yield out()

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States sorted by group: all groups but the last one of a batch are complete."""
        last_keys, last_states, schema = None, None, None

        def out(own: pd.DataFrame, states: np.ndarray) -> pa.RecordBatch:
            values = pa.array(np.asarray(function.finish(states), np.float64))
            return pa.RecordBatch.from_arrays([*(pa.array(own[k], schema.field(k).type, from_pandas=True) for k in arrow_keys), values], [*arrow_keys, name])

        for batch in batches:
            if not len(batch):
                continue
            schema = batch.schema
            given = batch.column("_state").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            frame = batch.select(arrow_keys).to_pandas()
            if last_keys is not None:
                frame, given = pd.concat([last_keys, frame], ignore_index=True), np.concatenate([last_states, given])
            groups, own = _numbered(frame)
            states = function.merge(groups, len(own), given)
            end = int(groups[-1])  # the group that may go on
            keep = np.arange(len(own)) != end
            if keep.any():
                yield out(own[keep], states[keep])
            last_keys, last_states = own.iloc[[end]].reset_index(drop=True), states[[end]]
        if last_keys is not None:
            yield out(last_keys, last_states)

    given = rows.select(*keys, *columns).dropna(subset=columns)
    return given.mapInArrow(partials, state).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).mapInArrow(finished, result)
