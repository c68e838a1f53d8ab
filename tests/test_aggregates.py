"""A user's aggregates however rows are dealt out; fits against plain likelihoods; tables with and without optional columns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from uvsieve.operators import aggregates, distributions, summary
from uvsieve.sources import schemas
from uvsieve.sources.observation import DerivedObservation, Observation

FOLDER = "/root/testdata/sf0.001"


class Extent:
    """Not a sum: the least and the greatest value."""

    columns = ("value",)

    def partial(self, groups, n, value):
        return self.merge(groups, n, np.c_[value, value])

    def merge(self, groups, n, states):
        out = np.c_[np.full(n, np.inf), np.full(n, -np.inf)]
        np.minimum.at(out[:, 0], groups, states[:, 0])
        np.maximum.at(out[:, 1], groups, states[:, 1])
        return out

    def finish(self, states):
        return states[:, 1] - states[:, 0]


@pytest.mark.parametrize("parts,held", [(1, 10**6), (7, 10**6), (5, 3)])
def test_splitting_changes_nothing(spark, parts, held):
    draw = random.Random(6)
    rows = [(None if k % 11 == 0 else "ab"[k % 2], 0 if k % 3 else k % 50, draw.gauss(0, 1) if k % 13 else None, -1.0, 1.0) for k in range(5000)]
    df = spark.createDataFrame(rows, "name string, cell int, value double, low double, high double").repartition(parts)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        means = {(r[0], r[1]): r[2] for r in aggregates.aggregate(df, ["name", "cell"], aggregates.TrimmedMean(), "mean", held).collect()}
        extents = {(r[0], r[1]): r[2] for r in aggregates.aggregate(df, ["name", "cell"], Extent(), "extent", held).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    groups = {}
    for name, cell, value, *_ in rows:
        if value is not None:
            groups.setdefault((name, cell), []).append(value)
    assert set(means) == set(extents) == set(groups)
    for k, v in groups.items():
        inner = [x for x in v if -1 <= x <= 1]
        assert extents[k] == pytest.approx(max(v) - min(v)) and (means[k] == pytest.approx(sum(inner) / len(inner)) if inner else math.isnan(means[k]))
    assert aggregates.aggregate(df.limit(0), ["cell"], Extent(), "extent").count() == 0


def loss(name, x, p):
    """The mean negative log-likelihood, in plain Python."""
    if name == "weibull":
        k, s = p
        return float(np.mean(-np.log(k / s) - (k - 1) * np.log(x / s) + (x / s) ** k))
    if name == "gamma":
        k, s = p
        return float(np.mean(-(k - 1) * np.log(x) + x / s)) + k * math.log(s) + math.lgamma(k)
    nu, s = p
    z = x * nu / s**2
    return float(np.mean(-np.log(x / s**2) + (x * x + nu * nu) / (2 * s * s) - np.log(np.i0(z))))


@pytest.mark.parametrize("name", ["weibull", "gamma", "rice"])
def test_fits_are_where_the_likelihood_is_greatest(spark, name):
    rng = np.random.default_rng(11)
    x = {"weibull": 3 * rng.weibull(1.7, 3000), "gamma": rng.gamma(2.5, 1.5, 3000), "rice": np.hypot(rng.normal(3, 1.2, 3000), rng.normal(0, 1.2, 3000))}[name]
    df = spark.createDataFrame([(float(v),) for v in x], "value double").repartition(4).cache()
    found = distributions.distribution(name).fit(df, "value")
    p = [found[n] for n in distributions.distribution(name).parameters]
    least = loss(name, x, p)
    for i in (0, 1):  # the slope is nothing there, to 1e-6 of the parameter
        h = 1e-4
        up, down = (loss(name, x, [v * (1 + d * h) if k == i else v for k, v in enumerate(p)]) for d in (1, -1))
        assert up > least and down > least and abs(up - down) / (up + down - 2 * least) * h / 2 < 1e-6
    grid = np.linspace(0, 30, 6001)
    density = [r[0] for r in spark.createDataFrame([(float(v),) for v in grid], "x double").select(distributions.distribution(name).pdf(F.col("x"), found)).collect()]
    assert sum(density) * (grid[1] - grid[0]) == pytest.approx(1, abs=1e-4)


def test_bessel_functions():
    z = np.array([0.0, 1e-6, 0.5, 3.0, 10.0, 24.9, 25.1, 80.0, 600.0])
    assert np.allclose(distributions.log_i0_of(z)[:-1], np.log(np.i0(z[:-1])), rtol=1e-11, atol=1e-13)
    h = 1e-5
    slope = (distributions.log_i0_of(z[2:] + h) - distributions.log_i0_of(z[2:] - h)) / (2 * h)  # the ratio is the slope of ln I0
    assert np.allclose(distributions.ratio_of(z[2:]), slope, rtol=1e-8)
    assert abs(distributions.digamma(1.0) + 0.5772156649015329) < 1e-12 and abs(distributions.trigamma(1.0) - math.pi**2 / 6) < 1e-11


def test_registry(spark):
    with pytest.raises(ValueError, match="no distribution"):
        distributions.distribution("other")
    with pytest.raises(ValueError, match="there is"):
        distributions.register(distributions.REGISTRY["normal"])
    with pytest.raises(ValueError, match="no rows"):
        distributions.distribution("normal").fit(spark.createDataFrame([], "value double"), "value")


def test_tables_with_and_without_columns(spark, tmp_path):
    derived, folder = DerivedObservation(spark, FOLDER), f"file://{tmp_path}"
    derived.sources.write.parquet(f"{folder}/all/source.parquet")
    derived.sources.drop("rest_frequency", "sysvel", "spw_id").write.parquet(f"{folder}/none/source.parquet")
    derived.sources.where("source_id = 1").withColumnRenamed("name", "NAME").write.parquet(f"{folder}/some/source.parquet")
    derived.sources.where("source_id <> 1").drop("sysvel").withColumnRenamed("name", "NAME").write.mode("append").parquet(f"{folder}/some/source.parquet")
    read = {k: summary.source_list(Observation(spark, f"{folder}/{k}").sources) for k in ("all", "none", "some")}
    want = {r["source_id"]: tuple(r) for r in summary.source_list(derived.sources).collect()}
    assert {r["source_id"]: tuple(r) for r in read["all"].collect()} == want
    assert all(r["rest_frequency"] == r["system_velocity"] == 0 and r["spw_id"] is None for r in read["none"].collect())
    got = {r["source_id"]: tuple(r) for r in read["some"].collect()}
    assert got == {k: v[:4] + ((v[4] if k == 1 else 0.0),) for k, v in want.items()}
    sources = Observation(spark, f"{folder}/all").sources
    assert schemas.unit_of(sources, "rest_frequency") == "Hz" and schemas.unit_of(sources, "name") == ""
    derived.sources.drop("name").write.parquet(f"{folder}/bad/source.parquet")
    with pytest.raises(ValueError, match="source lacks name"):
        Observation(spark, f"{folder}/bad").sources  # noqa: B018


def test_declared_tables_are_the_derived_ones(spark, tmp_path):
    derived, folder = DerivedObservation(spark, FOLDER), f"file://{tmp_path}"
    for name in schemas.SCHEMAS:
        derived.table(name).write.parquet(f"{folder}/{name}.parquet")
        assert {c.lower() for c in schemas.SCHEMAS[name]} <= set(derived.table(name).columns), name
    o = Observation(spark, folder)
    assert [tuple(r) for r in summary.antenna_list(o.antennas).orderBy("antenna_id").collect()] == [tuple(r) for r in summary.antenna_list(derived.antennas).orderBy("antenna_id").collect()]
    assert sorted(map(repr, summary.summary_lines(o).collect())) == sorted(map(repr, summary.summary_lines(derived).collect()))
    assert {"data", "corrected_data", "model"} <= set(o.main.columns)
