"""Baselines as a field sees them: antenna positions turned by the hour angle."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import LIGHT
from .summary import longest_baseline

#: Fixed values of mean sidereal time at Greenwich in degrees, by days from the epoch, and centuries squared and cubed; and the epoch as a modified Julian date.
SIDEREAL, EPOCH = (280.46061837, 360.98564736629, 0.000387933, 1 / 38_710_000), 51_544.5


def sidereal_angle(seconds: float, longitude: float) -> float:
    """Local mean sidereal time in radians at so many modified Julian seconds, at a longitude in radians."""
    days = seconds / 86_400 - EPOCH
    centuries = days / 36_525
    degrees = SIDEREAL[0] + SIDEREAL[1] * days + SIDEREAL[2] * centuries**2 - SIDEREAL[3] * centuries**3
    return math.radians(degrees % 360) + longitude


def projected(antennas: DataFrame, hour_angle: float, declination: float) -> DataFrame:
    """``antennas(antenna_id, position)`` with positions as seen along a direction: u to the east, v to the north, and nothing along the line of sight."""
    x, y, z = (F.col("position")[k] for k in range(3))
    sh, ch, sd, cd = math.sin(hour_angle), math.cos(hour_angle), math.sin(declination), math.cos(declination)
    u, v = x * sh + y * ch, -x * (sd * ch) + y * (sd * sh) + z * cd
    return antennas.select("antenna_id", F.array(u, v, F.lit(0.0)).alias("position"))


def longest_projections(observation, field_id: int) -> DataFrame:
    """(moment, wavelengths): the longest baseline that a field sees when the observation begins, half-way and when it ends, in wavelengths of the highest frequency.

    The longest baseline of a projection is the greatest distance between its points, so no pairs are formed but those that ``longest_baseline`` has to look at."""
    o = observation
    row = o.fields.where(F.col("field_id") == field_id).select("reference_dir").first()
    if row is None:
        raise ValueError(f"no field {field_id}")
    ra, declination = row["reference_dir"][0]
    middle = o.antennas.agg(*[F.avg(F.col("position")[k]).alias(c) for k, c in enumerate("xy")]).first()
    span = o.main.agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
    highest = o.windows.agg(F.max(F.array_max("chan_freq"))).first()[0]
    if middle["x"] is None or span["a"] is None or highest is None:
        raise ValueError("no antennas, rows or frequencies")
    longitude = math.atan2(middle["y"], middle["x"])
    moments = {"begin": span["a"], "middle": (span["a"] + span["b"]) / 2, "end": span["b"]}
    found = [longest_baseline(projected(o.antennas, sidereal_angle(t, longitude) - ra, declination)).select(F.lit(name).alias("moment"), (F.col("distance") * (highest / LIGHT)).alias("wavelengths")) for name, t in moments.items()]
    return reduce(DataFrame.unionByName, found)
