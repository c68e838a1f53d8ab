"""Clipping against NumPy: jobs that don't grow with the rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from uvsieve.operators import clipping


def clipped(x, low, high, median):
    """What is left after at most 100 rounds, and the rounds that took rows."""
    x, rounds = np.sort(np.array(x)), 0
    while len(x) >= 2 and rounds < 100:
        c = np.median(x) if median else x.mean()
        s = np.sqrt(max((x**2).sum() - len(x) * c * c, 0) / (len(x) - 1))
        kept = x[(x > c - low * s) & (x < c + high * s)]
        if len(kept) == len(x):
            break
        x, rounds = kept, rounds + 1
    return x.tolist(), rounds


def skewed():
    rng = np.random.default_rng(5)
    return {f"g{k}": (np.r_[rng.exponential(1, 150 + k) ** 7, -1e6, 3.0, 3.0] * 1.0).tolist() for k in range(6)} | {"one": [4.0], "two": [1.0, 9.0], "few": [1.0, 1.0, 2.0, 2.0]}


def rows_of(spark, values, parts=5):
    rows = [(k, v) for k, vs in values.items() for v in vs]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "g string, value double").repartition(parts)


def left(rows, bounds):
    return {r[0]: r[1] for r in clipping.within(rows, bounds, ["g"]).groupBy("g").agg(F.array_sort(F.collect_list("value"))).collect()}


def jobs(spark, name, f):
    """What ``f`` gives, and how many jobs it ran."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        found = f()
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("centre", ["mean", "median"])
def test_rounds_run_within_one_shuffle(spark, centre):
    values = skewed()
    want = {k: clipped(v, 3.0, 2.5, centre == "median") for k, v in values.items()}
    assert max(rounds for _, rounds in want.values()) >= 12
    rows = rows_of(spark, values).localCheckpoint()
    bounds, n = jobs(spark, f"clip {centre}", lambda: clipping.clip_groups(rows, 3.0, high_sigma=2.5, keys=["g"], centre=centre))
    assert n <= 12
    assert left(rows, bounds) == {k: x for k, (x, _) in want.items()}


def test_rounds_may_be_few(spark):
    values = {"g": [float(2**k) for k in range(40)]}
    rows = rows_of(spark, values)
    for rounds in (1, 3):
        x = np.array(values["g"])
        for _ in range(rounds):
            x = x[abs(x - x.mean()) < 2 * x.std(ddof=1)]
        assert left(rows, clipping.clip_groups(rows, 2.0, rounds, keys=["g"])) == {"g": x.tolist()}


def test_bounds_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    values = {"a": [0.1] * 30, "b": (rng.normal(0, 1, 500) * 1e6 + 0.1).tolist(), "c": [0.1, 0.7] * 20}
    found = [sorted(map(tuple, clipping.clip_groups(rows_of(spark, values, parts), 3.0, keys=["g"]).collect())) for parts in (1, 7)]
    assert found[0] == found[1]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame(
        [(nan, 1.0), (nan, 2.0), (1.0, nan), (1.0, inf), (1.0, -inf), (1.0, None), (2.0, 5.0), (2.0, nan), (2.0, inf), (None, 1.0), (3.0, 1e200), (3.0, -1e200), (3.0, 1.0), (4.0, 2.0), (4.0, 2.0)], "g double, value double"
    )
    bounds = clipping.clip_groups(rows, 3.0, keys=["g"])
    assert sorted(str(r["g"]) for r in bounds.collect()) == ["2.0", "3.0", "4.0", "nan"]
    found = {str(k): v for k, v in left(rows, bounds).items()}
    assert found == {"2.0": [5.0], "3.0": [-1e200, 1.0, 1e200], "nan": [1.0, 2.0]}  # equal values have no spread, so nothing lies strictly inside


def large():
    rng = np.random.default_rng(8)
    return skewed() | {
        "normal": rng.normal(50, 1, 900).tolist(), "spikes": [*rng.normal(0, 1, 500).tolist(), *[7.0] * 90, *[-400.0] * 40, 1e6], "few values": rng.choice([1.0, 1.0, 2.0, 2.0, 2.0, 9.0, 80.0], 700).tolist(),
        "powers": [float(1.5**k) for k in range(120)], "equal but one": [*[3.0] * 200, 4.0],
    }


@pytest.mark.parametrize("centre", ["mean", "median"])
def test_large_groups_take_few_jobs(spark, centre):
    values = large()
    want = {k: clipped(v, 3.0, 2.5, centre == "median") for k, v in values.items()}
    assert max(rounds for _, rounds in want.values()) >= 12
    rows = rows_of(spark, values).localCheckpoint()
    bounds, n = jobs(spark, f"blocks {centre}", lambda: clipping.clip_groups(rows, 3.0, high_sigma=2.5, keys=["g"], centre=centre, hot=60, block=16))
    assert n <= 70
    found = left(rows, bounds)
    for k, (x, _) in want.items():
        assert found.get(k, []) == x, k


def test_a_value_that_fills_blocks_is_dealt_out(spark):
    rows = spark.range(6000, numPartitions=6).select(F.lit(1).alias("g"), F.when(F.col("id") % 100 == 0, F.col("id") / 10.0).otherwise(5.0).alias("value")).localCheckpoint()
    values = [r["value"] for r in rows.collect()]
    bounds = clipping.clip_groups(rows, 3.0, keys=["g"], hot=100, block=64)
    assert left(rows, bounds).get(1, []) == clipped(values, 3.0, 3.0, False)[0]


@pytest.mark.parametrize("median", [False, True])
def test_rounds_are_followed_on_blocks(median):
    rng = np.random.default_rng(4)
    for n, size in ((40, 3), (3000, 64), (600_000, 256)):
        x = np.sort(np.r_[rng.exponential(1, n) ** 3, rng.normal(0, 40, n // 10)])
        parts = np.split(x, np.arange(size, len(x), size))
        ends = (np.array([p[0] for p in parts]), np.array([p[-1] for p in parts]), np.array([len(p) for p in parts]), np.array([p.sum() for p in parts]), np.array([(p * p).sum() for p in parts]))
        want, rounds = clipped(x, 3.0, 2.5, median)
        opened, passes = set(), 0
        while True:
            low, high, asked = clipping._followed(*ends, [p if k in opened else None for k, p in enumerate(parts)], (3.0, 2.5, 100, median))
            if asked is None:
                break
            opened, passes = asked, passes + 1
        assert x[(x > low) & (x < high)].tolist() == want
        assert passes <= rounds + 1
        if len(parts) > 1000:
            assert passes <= 6 and len(opened) < len(parts) / 3  # as the rounds need, not as the group has
