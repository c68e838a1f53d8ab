"""Stokes parameters and flags from correlation arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which two correlations make each parameter (1-based, -1 is the last) and the sign of the second.
PAIRS = {"I": (1, -1, 1), "Q": (1, -1, -1), "U": (2, 3, 1), "V": (2, 3, -1)}


def _pair(stokes: str) -> tuple[int, int, int]:
    if stokes not in PAIRS:
        raise ValueError(f"unknown Stokes parameter {stokes}")
    return PAIRS[stokes]


def amplitude(c: Column) -> Column:
    """Of a struct of re and im."""
    re, im = c["re"].cast("double"), c["im"].cast("double")
    return F.sqrt(re * re + im * im)


def stokes_value(data: Column, stokes: str, component: str = "real") -> Column:
    """The real part, or the amplitude, of a Stokes parameter of ``array<struct<re,im>>``."""
    i, j, sign = _pair(stokes)
    a, b = F.element_at(data, i), F.element_at(data, j)
    re = a["re"].cast("double") + sign * b["re"].cast("double")
    if component == "real":
        return re
    if component != "abs":
        raise ValueError(f"component must be real or abs, not {component}")
    im = a["im"].cast("double") + sign * b["im"].cast("double")
    return F.sqrt(re * re + im * im)


def stokes_flag(flags: Column, stokes: str) -> Column:
    """Whether either correlation of a parameter is flagged; ``A``: any correlation."""
    if stokes == "A":
        return F.exists(flags, lambda f: f)
    i, j, _ = _pair(stokes)
    return F.element_at(flags, i) | F.element_at(flags, j)


def complex_difference(a: Column, b: Column) -> Column:
    """Element by element, of two ``array<array<struct<re,im>>>`` (channel x correlation)."""
    minus = lambda x, y: F.struct((x["re"] - y["re"]).alias("re"), (x["im"] - y["im"]).alias("im"))
    return F.zip_with(a, b, lambda p, q: F.zip_with(p, q, minus))
