"""Scalar formatting of observation metadata, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of correlation codes, from 0.
CORRELATIONS = (
    "Undefined I Q U V RR RL LR LL XX XY YX YY RX RY LX LY XR XL YR YL PP PQ QP QQ RCircular LCircular Linear Ptotal Plinear PFtotal PFlinear Pangle"
).split()
#: Days from the start of modified Julian dates to that of Unix time.
MJD_UNIX = 40_587


def correlation_names(codes: Column) -> Column:
    names = F.array(*[F.lit(n) for n in CORRELATIONS])
    return F.array_join(F.transform(codes, lambda c: F.try_element_at(names, (c + 1).cast("int"))), ",")


def mjd_timestamp(seconds: Column) -> Column:
    """A timestamp from modified-Julian-date seconds."""
    return F.timestamp_micros(F.round((seconds - F.lit(float(MJD_UNIX * 86_400))) * 1_000_000).cast("bigint"))


def clock(seconds: Column, pattern: str = "dd-MMM-yyyy HH:mm:ss") -> Column:
    return F.date_format(mjd_timestamp(seconds), pattern)


def degrees_minutes_seconds(degrees: Column) -> Column:
    """``[-]d.mm.ss.ss``; the sign is kept apart, so negative angles come out right. Works in whole hundredths of a second."""
    hundredths = F.round(F.abs(degrees) * 360_000).cast("bigint")
    return F.format_string("%s%d.%02d.%02d.%02d", F.when((degrees < 0) & (hundredths > 0), "-").otherwise(""), F.floor(hundredths / 360_000), F.pmod(F.floor(hundredths / 6_000), F.lit(60)), F.pmod(F.floor(hundredths / 100), F.lit(60)), F.pmod(hundredths, F.lit(100)))


def hours_minutes_seconds(radians: Column) -> Column:
    """Right ascension ``h:mm:ss.ss`` of an angle in radians."""
    hundredths = F.pmod(F.round(F.degrees(radians) / 15 * 360_000).cast("bigint"), F.lit(24 * 360_000))
    return F.format_string("%d:%02d:%02d.%02d", F.floor(hundredths / 360_000), F.pmod(F.floor(hundredths / 6_000), F.lit(60)), F.pmod(F.floor(hundredths / 100), F.lit(60)), F.pmod(hundredths, F.lit(100)))


def heat_colour(value: Column, top: Column) -> Column:
    """A hex colour from blue to red; black above ``top``, grey where there is nothing."""
    share = F.floor(F.try_divide(value, top) * 255).cast("int")
    return F.when(value == 0, "#808080").when(value > top, "#000000").otherwise(F.format_string("#%02x%02x%02x", share, F.lit(0), 255 - share))


def range_bounds(text: Column) -> tuple[Column, Column, Column]:
    """Low, high and unit of ``[spw:]low~highUNIT``; a lone number is both bounds."""
    pattern = r"^(?:[^:]*:)?\s*([0-9.]+)(?:\s*~\s*([0-9.]+))?\s*([A-Za-z]*)\s*$"
    low, high = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return low.cast("double"), F.when(high == "", low).otherwise(high).cast("double"), F.regexp_extract(text, pattern, 3)
