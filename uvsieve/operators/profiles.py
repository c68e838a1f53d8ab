"""Diagnostic profiles: histograms, radial profiles, fits, hexagons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import settled
from .selection import LIMIT, medians_and_mads


def equal_width(x: Column, low: Column, high: Column, n: int) -> Column:
    """The bin of ``n`` equal ones, from 0; the last holds its upper end, outside is null."""
    at = F.floor((x - low) / (high - low) * n).cast("int")
    return F.when((x >= low) & (x <= high), F.least(at, F.lit(n - 1)))


def histogram(rows: DataFrame, n: int, value: str = "value", low: float | None = None, high: float | None = None, weight: str | None = None) -> DataFrame:
    """(bin, left, right, n, density) over the range given, or that of the values. Bins without rows are absent."""
    span = rows.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    a, b = span["a"] if low is None else low, span["b"] if high is None else high
    if a is None or not a < b:
        raise ValueError("the range is empty")
    amount = F.sum(weight) if weight else F.count("*")
    found = rows.withColumn("bin", equal_width(F.col(value), F.lit(a), F.lit(b), n)).where(F.col("bin").isNotNull()).groupBy("bin").agg(amount.alias("n"))
    total = found.agg(F.sum("n")).first()[0] or 0
    width = (b - a) / n
    return found.select("bin", (F.lit(a) + F.col("bin") * width).alias("left"), (F.lit(a) + (F.col("bin") + 1) * width).alias("right"), "n", (F.col("n") / F.lit(float(total * width))).alias("density"))


def histogram_by(rows: DataFrame, keys: list[str], n: int, value: str = "value", *, low: float, high: float) -> DataFrame:
    """(keys, bin, n): a histogram of each group in the same bins, by one aggregate. Bins without rows are absent."""
    return rows.withColumn("bin", equal_width(F.col(value), F.lit(low), F.lit(high), n)).where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def radial_profile(cells: DataFrame, value: str, n: int) -> DataFrame:
    """(bin, centre, n, median, std) of cell values in ``n`` radius bins of equal width, those on a bin's edge left out."""
    span = cells.agg(F.min("radius").alias("a"), F.max("radius").alias("b")).first()
    a, width = span["a"], (span["b"] - span["a"]) / n
    at = F.floor((F.col("radius") - a) / width).cast("int")
    inside = (F.col("radius") > a + at * width) & (F.col("radius") < a + (at + 1) * width)
    return cells.where(inside).withColumn("bin", at).groupBy("bin").agg(F.count("*").alias("n"), F.median(value).alias("median"), F.stddev_pop(value).alias("std")).withColumn("centre", F.lit(a) + (F.col("bin") + 0.5) * width)


def ring_profile(cells: DataFrame, value: str = "median") -> DataFrame:
    """(annulus_id, n, mean, median) of cell values by ring."""
    return cells.where(F.col("annulus_id").isNotNull()).groupBy("annulus_id").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def ring_stats(values: DataFrame, hot: int = LIMIT) -> DataFrame:
    """(annulus_id, n, mean, median, mad, low, high) of all values in a ring's cells, with the Rayleigh band at two sigmas. A ring may hold any share of the rows: medians are selected, not gathered.
    The narrow rows are settled once."""
    rows = settled(values.select("annulus_id", "value"))
    means = rows.groupBy("annulus_id").agg(F.avg("value").alias("mean"))
    scale = F.col("median") / math.sqrt(2 * math.log(2))
    tail = 0.04550026
    found = medians_and_mads(rows, ["annulus_id"], limit=hot).join(means, "annulus_id")
    return found.withColumn("low", scale * math.sqrt(-2 * math.log(1 - tail / 2))).withColumn("high", scale * math.sqrt(-2 * math.log(tail / 2)))


def fits(rows: DataFrame, value: str = "value") -> DataFrame:
    """Closed-form maximum-likelihood fits in one pass: normal, Rayleigh (from zero) and lognormal (of positive values)."""
    x = F.col(value)
    positive = F.when(x > 0, F.ln(x))
    return rows.agg(F.avg(x).alias("norm_mean"), F.stddev_pop(x).alias("norm_std"), F.sqrt(F.avg(x * x) / 2).alias("rayleigh_sigma"), F.avg(positive).alias("lognorm_mean"), F.stddev_pop(positive).alias("lognorm_std"))


def rayleigh_density(x: Column, sigma: Column) -> Column:
    return x / (sigma * sigma) * F.exp(-(x * x) / (2 * sigma * sigma))


def hexagons(rows: DataFrame, x: str, y: str, size: float = 1.0, aspect: float = 0.01) -> DataFrame:
    """(q, r, n): counts in pointy hexagons of axial coordinates, y scaled by ``aspect``."""
    px, py = F.col(x) / size, F.col(y) * F.lit(1 / aspect) / size
    q, r = px * (math.sqrt(3) / 3) - py / 3, py * (2 / 3)
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return rows.select(fq.cast("int").alias("q"), fr.cast("int").alias("r")).groupBy("q", "r").agg(F.count("*").alias("n"))


def sample_rows(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """A seeded sample with replacement, in order."""
    return rows.sample(withReplacement=True, fraction=share, seed=seed).orderBy("u_bin", "v_bin")
