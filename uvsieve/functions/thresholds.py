"""Outlier thresholds as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two-sided tail beyond 1 to 5 standard deviations.
TAILS = {1: 0.31731051, 2: 0.04550026, 3: 0.00269980, 4: 0.00006334, 5: 0.00000057}
#: Makes a median absolute deviation estimate a standard deviation.
MAD_SCALE = 1.4826


def rayleigh_sigma(median: Column) -> Column:
    return median / F.lit(math.sqrt(2 * math.log(2)))


def rayleigh_low(median: Column, alpha: Column) -> Column:
    return rayleigh_sigma(median) * F.sqrt(-2 * F.ln(1 - alpha / 2))


def rayleigh_high(median: Column, alpha: Column) -> Column:
    return rayleigh_sigma(median) * F.sqrt(-2 * F.ln(alpha / 2))


def fixed_alpha(sigma: int) -> float:
    if sigma not in TAILS:
        raise ValueError(f"sigma must be 1 to 5, not {sigma}")
    return TAILS[sigma]


def checked_alpha(alpha: float) -> float:
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha must lie between 0 and 1, not {alpha}")
    return alpha


def sigma_clip(values: Column, low: float, high: float, rounds: int = 100, use_median: bool = False) -> Column:
    """What is left of an array after clipping ``low`` and ``high`` standard deviations about its centre, again and again
    until nothing more goes, for arrays that are known to be small. Larger groups: ``operators.flags.clip_groups``."""

    def step(kept: Column, _: Column) -> Column:
        n = F.size(kept)
        total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)
        squares = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x * x)
        ordered = F.array_sort(kept)
        middle = (F.element_at(ordered, F.greatest(F.ceil(n / 2).cast("int"), F.lit(1))) + F.element_at(ordered, F.greatest(F.floor(n / 2 + 1).cast("int"), F.lit(1)))) / 2
        centre = middle if use_median else total / n
        spread = F.sqrt(F.greatest(squares - n * centre * centre, F.lit(0.0)) / (n - 1))
        return F.when(n < 2, kept).otherwise(F.filter(kept, lambda x: (x > centre - low * spread) & (x < centre + high * spread)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), values, step)
