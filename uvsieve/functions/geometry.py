"""Baseline geometry as column expressions: wavelengths, grid limits, edges, binning, distances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Speed of light in m/s.
LIGHT = 299_792_458.0


def wavelength(frequency: Column) -> Column:
    return F.lit(LIGHT) / frequency


def field_of_view(wave: Column, diameter: Column) -> Column:
    """Width of the primary beam in radians."""
    return F.lit(1.22) * wave / diameter


def uv_distance(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def linspace(low: float, high: float, n: int) -> list[float]:
    """``n`` numbers from ``low`` to ``high``, both included."""
    if n < 2:
        return [low][:n]
    step = (high - low) / (n - 1)
    return [*(low + i * step for i in range(n - 1)), high]


@dataclass(frozen=True)
class Axis:
    """One axis of the grid: ``count`` edges from ``low`` to ``high``."""

    low: float
    high: float
    count: int

    @property
    def edges(self) -> list[float]:
        return linspace(self.low, self.high, self.count)

    def edge(self, k: Column) -> Column:
        """Edge number ``k``, from 0: the same arithmetic as ``edges``."""
        step = (self.high - self.low) / (self.count - 1) if self.count > 1 else 0.0
        inner = F.lit(self.low) + k * F.lit(step)
        return F.when(k == self.count - 1, F.lit(self.high)).otherwise(inner) if self.count > 1 else inner

    def bin(self, x: Column) -> Column:
        """How many edges are at most ``x``: 0 below the first, ``count`` at and beyond the last."""
        if self.count < 2 or self.low == self.high:
            return F.when(x >= F.lit(self.low), self.count).otherwise(0).cast("int")
        # equal-width buckets, put right by one where rounding differs from the edges themselves
        guess = F.width_bucket(x, F.lit(self.low), F.lit(self.high), F.lit(self.count - 1)).cast("int")
        up = (guess < self.count) & (x >= self.edge(guess))
        down = (guess > 0) & (x < self.edge(guess - 1))
        return (guess + F.when(up, 1).when(down, -1).otherwise(0)).cast("int")

    def edge_of(self, number: Column) -> Column:
        """The lower edge of a bin; bin 0 wraps round to the last edge."""
        return self.edge(F.when(number == 0, self.count - 1).otherwise(number - 1))


@dataclass(frozen=True)
class Grid:
    u: Axis
    v: Axis

    def radius(self, u_bin: Column, v_bin: Column) -> Column:
        return uv_distance(self.u.edge_of(u_bin), self.v.edge_of(v_bin))

    def binned(self, rows: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
        return rows.withColumn("u_bin", self.u.bin(F.col(u))).withColumn("v_bin", self.v.bin(F.col(v)))


def statistical_width(spread: float, n: int) -> float:
    """Bin width from the spread of a coordinate and the number of rows."""
    return spread * 3.5 / n**0.25


def grid_limits(rows: DataFrame) -> DataFrame:
    """Limits of both axes in shortest wavelengths, of ``rows(u_m, v_m, lam)``: one row."""
    least = F.min("lam")
    return rows.agg(
        (F.min("u_m") / least).alias("u_lo"), (F.max("u_m") / least).alias("u_hi"), (F.min("v_m") / least).alias("v_lo"), (F.max("v_m") / least).alias("v_hi"),
        least.alias("lam_min"), F.max("lam").alias("lam_max"), F.count("*").alias("n"), F.stddev_pop(F.col("u_m") / F.col("lam")).alias("u_std"), F.stddev_pop(F.col("v_m") / F.col("lam")).alias("v_std"),
    )


def observation_limits(main: DataFrame, windows: DataFrame) -> DataFrame:
    """Limits of both axes as ``grid_limits`` gives them, of ``main(u_m, v_m)`` and all channels of ``windows(chan_freq)``: one row. Nothing is exploded but the windows."""
    lam = windows.select(F.explode("chan_freq").alias("f")).agg((F.lit(LIGHT) / F.max("f")).alias("lam_min"), (F.lit(LIGHT) / F.min("f")).alias("lam_max"))
    span = main.agg(F.min("u_m").alias("u0"), F.max("u_m").alias("u1"), F.min("v_m").alias("v0"), F.max("v_m").alias("v1"), F.count("*").alias("n"))
    both = span.crossJoin(F.broadcast(lam))  # a row each
    return both.select(*[(F.col(f"{a}{k}") / F.col("lam_min")).alias(f"{a}_{e}") for a in "uv" for k, e in ((0, "lo"), (1, "hi"))], "lam_min", "lam_max", "n")


def physical_grid(limits: DataFrame, *, diameter: float, factor: float = 1.0) -> Grid:
    """The grid of a row of limits, with bins as wide as a field of view resolves; one small aggregate runs, everything after uses literals."""
    x = limits.first()
    if x is None or x["n"] == 0:
        raise ValueError("no rows to plan a grid from")
    wide = float(int(1 / (1.22 * x["lam_max"] / diameter)))
    counts = [int(factor * (x[f"{a}_hi"] - x[f"{a}_lo"]) / wide) if wide else 0 for a in "uv"]
    return Grid(Axis(x["u_lo"], x["u_hi"], counts[0]), Axis(x["v_lo"], x["v_hi"], counts[1]))


def plan_grid(rows: DataFrame, *, diameter: float, factor: float = 1.0, method: str = "physical") -> Grid:
    """The grid of ``rows(u_m, v_m, lam)``.

    physical: as ``physical_grid``; statistical: bins by spread and number of rows."""
    if method not in ("physical", "statistical"):
        raise ValueError(f"method must be physical or statistical, not {method}")
    if method == "physical":
        return physical_grid(grid_limits(rows), diameter=diameter, factor=factor)
    x = grid_limits(rows).first()
    if x["n"] == 0:
        raise ValueError("no rows to plan a grid from")
    widths = (statistical_width(x["u_std"], x["n"]), statistical_width(x["v_std"], x["n"]))
    counts = [int(factor * (x[f"{a}_hi"] - x[f"{a}_lo"]) / w) if w else 0 for a, w in zip("uv", widths, strict=True)]
    return Grid(Axis(x["u_lo"], x["u_hi"], counts[0]), Axis(x["v_lo"], x["v_hi"], counts[1]))
