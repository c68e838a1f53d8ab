"""Selection against NumPy: groups of all sizes, ties, spikes, missing values; and clipping by it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from uvsieve.functions import thresholds
from uvsieve.operators import flags, profiles, selection


def groups():
    rng, draw = np.random.default_rng(7), random.Random(7)
    return {
        1: rng.normal(0, 1, 3001).tolist(), 2: [draw.choice([0.0, 0.5, 1.0]) for _ in range(2000)], 3: [5.0] * 999, 4: [2.0], 5: [1.0, 2.0], 6: (rng.exponential(1, 2000) ** 9).tolist(),
        7: [*rng.normal(0, 1e-9, 1500).tolist(), 1e300, -1e300], 8: sorted(rng.uniform(0, 1, 1200).tolist()), 9: [None, 1.0, None, 3.0], 10: [None],
    }


@pytest.mark.parametrize("limit", [1, 10**9])
def test_quantiles_are_numpys(spark, limit):
    values = groups()
    rows = [(k, v) for k, vs in values.items() for v in vs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g int, value double").repartition(5)
    at = (0.0, 0.5, 0.77)
    got = {r["g"]: (r["n"], *[r[f"q{k}"] for k in range(len(at))]) for r in selection.quantiles(df, ["g"], at=at, limit=limit).collect()}
    want = {k: [v for v in vs if v is not None] for k, vs in values.items()}
    assert set(got) == {k for k, v in want.items() if v}
    for k, found in got.items():
        assert found[0] == len(want[k]) and found[1:] == pytest.approx(tuple(np.quantile(want[k], at)), rel=1e-12), k


def test_no_bracket_ends_wide(spark):
    df = spark.createDataFrame([(k % 2, float((k * 7919) % 10_007)) for k in range(10_007)], "g int, value double")
    state = selection.brackets(df, ["g"], limit=50).collect()
    assert all(r["_inside"] <= 50 and r["_low"] < r["_high"] for r in state)
    for r in state:
        own = [float((k * 7919) % 10_007) for k in range(r["g"], 10_007, 2)]
        assert sum(v < r["_low"] for v in own) == r["_below"] and sum(r["_low"] <= v <= r["_high"] for v in own) == r["_inside"]
        assert r["_next"] == min(v for v in own if v > r["_high"])


def test_rows_stay_where_they_are(spark, monkeypatch):
    df = spark.createDataFrame([(k % 3, float(k)) for k in range(300)], "g int, value double").repartition(4)
    state = selection.brackets(df, ["g"], limit=500)
    plan = lambda: selection._within(df, ["g"], "value", state)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan() and "hashpartitioning(g" not in plan()
    monkeypatch.setattr(selection, "MAX_BROADCAST", 2)
    assert "BroadcastHashJoin" not in plan() or "hashpartitioning(g" in plan()  # another way beyond the bound
    assert {r["g"]: r["q0"] for r in selection.quantiles(df, ["g"], limit=30).collect()} == {0: 148.5, 1: 149.5, 2: 150.5}


def test_a_start_that_misses_does_no_harm(spark):
    df = spark.createDataFrame([(g, float(k)) for g in range(4) for k in range(1001)], "g int, value double")
    start = spark.createDataFrame([(0, 0, 490.0, 510.0), (1, 0, 0.0, 3.0), (2, 0, 900.0, 901.0), (3, 0, 5000.0, 6000.0)], "g int, _t int, _try_low double, _try_high double")
    state = selection.brackets(df, ["g"], limit=30, start=start)
    assert {r["g"]: r["_q"] for r in selection.picked(df, ["g"], "value", state).collect()} == {g: 500.0 for g in range(4)}
    assert {r["_low"] for r in state.where("g = 0").collect()} == {490.0}  # the bracket that was tried


@pytest.mark.parametrize("limit", [20])
def test_ring_stats_by_selection(spark, limit):
    rng = np.random.default_rng(8)
    values = {k: rng.rayleigh(k + 1, 500 + k).tolist() for k in range(3)}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "annulus_id int, value double")
    for r in profiles.ring_stats(df, hot=limit).collect():
        v = np.array(values[r["annulus_id"]])
        m = np.median(v)
        assert (r["n"], r["mean"], r["median"], r["mad"]) == pytest.approx((len(v), v.mean(), m, 1.4826 * np.median(abs(v - m))))


def median_clipped(x, low, high):
    x = np.sort(np.array(x))
    while len(x) >= 2:
        c = np.median(x)
        s = np.sqrt(max((x**2).sum() - len(x) * c * c, 0) / (len(x) - 1))
        kept = x[(x > c - low * s) & (x < c + high * s)]
        if len(kept) == len(x):
            break
        x = kept
    return x.tolist()


@pytest.mark.parametrize("low,high,hot", [(4.0, 2.0, 10**9), (3.0, 3.5, 40)])
def test_median_clips_agree(spark, low, high, hot):
    rng = np.random.default_rng(9)
    values = {k: np.r_[rng.rayleigh(1, 60), rng.rayleigh(9, k)].tolist() for k in range(0, 8, 3)} | {20: [1.0], 22: [1.0, 1.0, 1.0, 5.0]}
    arrays = spark.createDataFrame([(k, v) for k, v in values.items()], "g int, x array<double>")
    by_array = {r[0]: sorted(r[1]) for r in arrays.select("g", thresholds.sigma_clip(F.col("x"), low, high, use_median=True)).collect()}
    rows = arrays.select("g", F.explode("x").alias("value"))
    bounds = flags.clip_groups(rows, low, high_sigma=high, centre="median", keys=["g"], hot=hot)
    left = rows.join(bounds, "g").where((F.col("value") > F.col("low")) & (F.col("value") < F.col("high"))).groupBy("g").agg(F.array_sort(F.collect_list("value")))
    by_rows = {r[0]: r[1] for r in left.collect()}
    for k, v in values.items():
        assert by_rows.get(k, []) == pytest.approx(median_clipped(v, low, high)) and by_array[k] == pytest.approx(by_rows.get(k, [])), k


def test_clipping_refuses_other_centres(spark):
    with pytest.raises(ValueError):
        flags.clip_groups(spark.createDataFrame([(1, 1, 1.0)], "u_bin int, v_bin int, value double"), 3.0, centre="mode")
