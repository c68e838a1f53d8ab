"""Flag counts of cells over a stream of visibilities.

An extension: counts add up, so they can be kept as a stream goes on; exact medians cannot, and are not streamed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Grid


def cell_counts(stream: DataFrame, grid: Grid, *, time: str = "time", window: str = "10 minutes", lateness: str = "30 minutes") -> DataFrame:
    """(window, u_bin, v_bin, n, flagged) of ``stream(time, u, v, flag)``; rows later than ``lateness`` are not counted."""
    binned = grid.binned(stream.withWatermark(time, lateness))
    return binned.groupBy(F.window(time, window), "u_bin", "v_bin").agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"))
