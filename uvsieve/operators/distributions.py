"""Distributions that values can be fitted with: each has ``fit`` and ``pdf``, and is found by name.

A fit is by maximum likelihood. Where the likelihood has no closed solution, each step is one aggregate of sums over the rows at the estimate so far, and the step itself is arithmetic on the driver on
these few sums. Rows are read once for each step: settle them if they are dear to make.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Parameters = dict[str, float]


@dataclass(frozen=True)
class Distribution:
    """parameters: their names. fit: of rows and a column's name. pdf: the density at a column, null or 0 where there is none."""

    name: str
    parameters: tuple[str, ...]
    fit: Callable[[DataFrame, str], Parameters]
    pdf: Callable[[Column, Parameters], Column]


REGISTRY: dict[str, Distribution] = {}


def register(distribution: Distribution) -> Distribution:
    """Adds a distribution, a user's own as well."""
    if distribution.name in REGISTRY:
        raise ValueError(f"there is a distribution {distribution.name}")
    REGISTRY[distribution.name] = distribution
    return distribution


def distribution(name: str) -> Distribution:
    if name not in REGISTRY:
        raise ValueError(f"no distribution {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def _sums(rows: DataFrame, **columns: Column) -> dict[str, float]:
    row = rows.agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in columns.items()]).first().asDict()
    if not row.pop("_n") or any(v is None for v in row.values()):
        raise ValueError("no rows to fit")
    return {k: float(v) for k, v in row.items()}


def _positive(rows: DataFrame, value: str) -> DataFrame:
    return rows.where(F.col(value) > 0)


STEPS, CLOSE = 200, 1e-12


def newton(at: float, step: Callable[[float], float], least: float = 0.0) -> float:
    """Steps from ``at`` until they no longer change it; a step to ``least`` or below is halved, and within a millionth of where it began, it is ``least``."""
    near = least + 1e-6 * (at - least)
    for _ in range(STEPS):
        new = at - step(at)
        new = new if new > least else (at + least) / 2
        if new < near:
            return least
        if abs(new - at) <= CLOSE * max(abs(at), 1.0):
            return new
        at = new
    raise RuntimeError("the fit did not settle")


# closed forms


def _fit_normal(rows: DataFrame, value: str) -> Parameters:
    return _sums(rows, mean=F.avg(value), std=F.stddev_pop(value))


def _pdf_normal(x: Column, p: Parameters) -> Column:
    z = (x - p["mean"]) / p["std"]
    return F.exp(-z * z / 2) / (p["std"] * math.sqrt(2 * math.pi))


def _fit_rayleigh(rows: DataFrame, value: str) -> Parameters:
    return _sums(rows, sigma=F.sqrt(F.avg(F.col(value) * F.col(value)) / 2))


def _pdf_rayleigh(x: Column, p: Parameters) -> Column:
    v = p["sigma"] ** 2
    return F.when(x >= 0, x / v * F.exp(-(x * x) / (2 * v))).otherwise(0.0)


def _fit_lognormal(rows: DataFrame, value: str) -> Parameters:
    log = F.ln(value)
    return _sums(_positive(rows, value), mean=F.avg(log), std=F.stddev_pop(log))


def _pdf_lognormal(x: Column, p: Parameters) -> Column:
    z = (F.ln(x) - p["mean"]) / p["std"]
    return F.when(x > 0, F.exp(-z * z / 2) / (x * (p["std"] * math.sqrt(2 * math.pi)))).otherwise(0.0)


def _fit_exponential(rows: DataFrame, value: str) -> Parameters:
    return _sums(rows, scale=F.avg(value))


def _pdf_exponential(x: Column, p: Parameters) -> Column:
    return F.when(x >= 0, F.exp(-x / p["scale"]) / p["scale"]).otherwise(0.0)


# by steps


def _fit_weibull(rows: DataFrame, value: str) -> Parameters:
    """The shape k solves sum(x^k ln x) / sum(x^k) - 1/k = mean(ln x); logarithms are taken from their mean, so that powers stay small."""
    rows = _positive(rows, value)
    known = _sums(rows, mean=F.avg(F.ln(value)), std=F.stddev_pop(F.ln(value)))
    y = F.ln(value) - known["mean"]
    last: dict[str, float] = {}

    def step(k: float) -> float:
        w = F.exp(y * k)
        s = _sums(rows, s0=F.avg(w), s1=F.avg(w * y), s2=F.avg(w * y * y))
        last.update(s, k=k)
        tilt = s["s1"] / s["s0"]
        return (tilt - 1 / k) / (s["s2"] / s["s0"] - tilt * tilt + 1 / (k * k))

    shape = newton(math.pi / math.sqrt(6) / known["std"], step)  # what the spread of logarithms says
    return {"shape": shape, "scale": math.exp(known["mean"] + math.log(last["s0"]) / last["k"])}


def _pdf_weibull(x: Column, p: Parameters) -> Column:
    k, z = p["shape"], x / p["scale"]
    return F.when(x > 0, k / p["scale"] * F.pow(z, F.lit(k - 1)) * F.exp(-F.pow(z, F.lit(k)))).otherwise(0.0)


def digamma(x: float) -> float:
    """The derivative of ln gamma: shifted beyond 10, then the asymptotic series."""
    total = 0.0
    while x < 10:
        total, x = total - 1 / x, x + 1
    w = 1 / (x * x)
    return total + math.log(x) - 1 / (2 * x) - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))


def trigamma(x: float) -> float:
    total = 0.0
    while x < 10:
        total, x = total + 1 / (x * x), x + 1
    w = 1 / (x * x)
    return total + 1 / x + w / 2 + w / x * (1 / 6 - w * (1 / 30 - w * (1 / 42 - w / 30)))


def _fit_gamma(rows: DataFrame, value: str) -> Parameters:
    """The shape solves ln k - digamma(k) = ln(mean x) - mean(ln x): the sums don't depend on k, so one aggregate does."""
    s = _sums(_positive(rows, value), mean=F.avg(value), log=F.avg(F.ln(value)))
    gap = math.log(s["mean"]) - s["log"]
    first = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    shape = newton(first, lambda k: (math.log(k) - digamma(k) - gap) / (1 / k - trigamma(k)))
    return {"shape": shape, "scale": s["mean"] / shape}


def _pdf_gamma(x: Column, p: Parameters) -> Column:
    k, t = p["shape"], p["scale"]
    return F.when(x > 0, F.exp((k - 1) * F.ln(x) - x / t - (k * math.log(t) + math.lgamma(k)))).otherwise(0.0)


#: From here on Bessel functions are taken from their asymptotic series.
FAR, DEPTH, TERMS = 25.0, 60, 12


def _series(z: np.ndarray, order: int) -> np.ndarray:
    """The asymptotic series of I0 or I1, without exp(z) / sqrt(2 pi z)."""
    total = np.ones_like(z)
    for k in range(TERMS, 0, -1):
        total = 1 - total * ((4 * order**2 - (2 * k - 1) ** 2) / (8.0 * k)) / z
    return total


def ratio_of(z: np.ndarray) -> np.ndarray:
    """I1(z) / I0(z) for z >= 0: a continued fraction, and far out the quotient of asymptotic series."""
    near = np.full_like(z, 2.0 * DEPTH)
    for k in range(DEPTH - 1, 0, -1):
        near = 2.0 * k + z * z / near
    far = np.maximum(z, FAR)
    return np.where(z < FAR, z / near, _series(far, 1) / _series(far, 0))


def log_i0_of(z: np.ndarray) -> np.ndarray:
    """ln I0(z) for z >= 0."""
    small, far = np.minimum(z, FAR), np.maximum(z, FAR)
    near = np.ones_like(z)
    for k in range(DEPTH, 0, -1):
        near = 1 + small * small / (4.0 * k * k) * near
    return np.where(z < FAR, np.log(near), far - np.log(far * (2 * math.pi)) / 2 + np.log(_series(far, 0)))


def bessel_ratio(z: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series(ratio_of(s.to_numpy(np.float64))), "double")(z)


def log_bessel(z: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series(log_i0_of(s.to_numpy(np.float64))), "double")(z)


def _fit_rice(rows: DataFrame, value: str) -> Parameters:
    """The distance nu is a fixed point of mean(x I1/I0(x nu / s)), where s is half of mean(x^2) - nu^2; Newton's steps on the difference, whose slope comes from the same aggregate."""
    rows, x = rows.where(F.col(value) >= 0), F.col(value)
    s = _sums(rows, square=F.avg(x * x), fourth=F.avg(x * x * x * x))
    whole = s["square"]

    def step(nu: float) -> float:
        v = (whole - nu * nu) / 2
        z, r = x * (nu / v), F.col("_r")
        slope_of_r = F.when(z > 0, 1 - r * r - r / z).otherwise(0.5)
        slope_of_z = 1 / v + nu * nu / (v * v)
        found = _sums(rows.select(value, bessel_ratio(z).alias("_r")), value=F.avg(x * r), slope=F.avg(x * x * slope_of_r) * slope_of_z)
        gap, slope = nu - found["value"], 1 - found["slope"]
        most = min(nu, math.sqrt(whole) - nu) / 2  # a step stays between 0 and the longest distance
        return max(-most, min(most, gap / slope if slope > 0 else gap))

    spread = 2 * whole**2 - s["fourth"]  # nu^4, if the moments are those of the distribution
    first = max(spread, 0.0) ** 0.25
    nu = newton(min(max(first, 0.05 * math.sqrt(whole)), 0.999 * math.sqrt(whole)), step)
    return {"nu": nu, "sigma": math.sqrt((whole - nu * nu) / 2)}


def _pdf_rice(x: Column, p: Parameters) -> Column:
    v, nu = p["sigma"] ** 2, p["nu"]
    return F.when(x > 0, x / v * F.exp(log_bessel(x * (nu / v)) - (x * x + nu * nu) / (2 * v))).otherwise(0.0)


for _d in (
    Distribution("normal", ("mean", "std"), _fit_normal, _pdf_normal), Distribution("rayleigh", ("sigma",), _fit_rayleigh, _pdf_rayleigh), Distribution("lognormal", ("mean", "std"), _fit_lognormal, _pdf_lognormal),
    Distribution("exponential", ("scale",), _fit_exponential, _pdf_exponential), Distribution("weibull", ("shape", "scale"), _fit_weibull, _pdf_weibull), Distribution("gamma", ("shape", "scale"), _fit_gamma, _pdf_gamma),
    Distribution("rice", ("nu", "sigma"), _fit_rice, _pdf_rice),
):
    register(_d)


def fitted(rows: DataFrame, names: list[str], value: str = "value") -> DataFrame:
    """(name, parameter, estimate) of the distributions asked for."""
    found = [(n, distribution(n).fit(rows, value)) for n in names]
    return rows.sparkSession.createDataFrame([(n, p, e[p]) for n, e in found for p in distribution(n).parameters], "name string, parameter string, estimate double")


def beside(histogram: DataFrame, fits: dict[str, Parameters]) -> DataFrame:
    """A histogram (bin, left, right, ...) with each fit's density at the middle of the bin, in columns named pdf_ and the distribution."""
    middle = (F.col("left") + F.col("right")) / 2
    return histogram.select("*", *[distribution(n).pdf(middle, p).alias(f"pdf_{n}") for n, p in fits.items()])
