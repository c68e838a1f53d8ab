"""Annuli: rings of cells of like radius, and the limits of each ring's medians.

There are ``n`` edges and limits, whatever the data, so they are collected and used as literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Grid
from ..functions.thresholds import MAD_SCALE


@dataclass(frozen=True)
class Annuli:
    """Outer edges (the first ring begins at 0) and each ring's lower and upper limit (None: no cell in it)."""

    edges: tuple[float, ...]
    lower: tuple[float | None, ...] = ()
    upper: tuple[float | None, ...] = ()

    def ring(self, radius: Column, median: Column) -> Column:
        """The ring of a cell: strictly between its edges, null on an edge or where the median is not positive."""
        r = F.round(radius, 6)
        chain = F.lit(None).cast("int")
        low = 0.0
        for k, high in enumerate(self.edges):
            chain = F.when((r > F.round(F.lit(low), 6)) & (r < F.round(F.lit(high), 6)), k).otherwise(chain)
            low = high
        return F.when(median > 0, chain)

    def limit(self, ring: Column) -> Column:
        """A ring's upper limit; cells without a ring take the last ring's."""
        limits = F.array(*[F.lit(x).cast("double") for x in self.upper])
        return F.element_at(limits, F.coalesce(ring + 1, F.lit(len(self.upper))))


def with_radius(cells: DataFrame, grid: Grid) -> DataFrame:
    return cells.withColumn("radius", grid.radius(F.col("u_bin"), F.col("v_bin")))


def edge_frame(cells: DataFrame, n: int) -> DataFrame:
    """(annulus_id, r_lo, r_hi) from the radii of cells with a positive median: quantiles at 1/n, 2/n, ... 1."""
    edges = cells.where(F.col("median") > 0).agg(F.percentile("radius", F.array(*[F.lit((k + 1) / n) for k in range(n)])).alias("e"))
    rows = edges.select("e", F.posexplode("e").alias("annulus_id", "r_hi"))
    return rows.select("annulus_id", F.when(F.col("annulus_id") == 0, 0.0).otherwise(F.element_at("e", F.greatest(F.col("annulus_id"), F.lit(1)))).alias("r_lo"), "r_hi")


def ring_limits(ringed: DataFrame, sigma: float) -> DataFrame:
    """(annulus_id, n_cells, ci_lower, ci_upper): exp of the median of ln(median) less and plus ``sigma`` scaled deviations."""
    logs = ringed.where(F.col("annulus_id").isNotNull()).withColumn("_l", F.ln("median"))
    middle = logs.groupBy("annulus_id").agg(F.median("_l").alias("_m"), F.count("*").alias("n_cells"))
    apart = logs.join(middle, "annulus_id").groupBy("annulus_id").agg(F.first("_m").alias("_m"), F.first("n_cells").alias("n_cells"), F.median(F.abs(F.col("_l") - F.col("_m"))).alias("_s"))
    width = F.lit(sigma * MAD_SCALE) * F.col("_s")
    return apart.select("annulus_id", "n_cells", F.exp(F.col("_m") - width).alias("ci_lower"), F.exp(F.col("_m") + width).alias("ci_upper"))


def plan_annuli(cells: DataFrame, n: int = 10, sigma: float = 3.0) -> Annuli:
    """Edges and limits of ``cells(u_bin, v_bin, median, radius)``: two small jobs over cells, ``n`` numbers each."""
    edges = tuple(r["r_hi"] for r in edge_frame(cells, n).orderBy("annulus_id").collect())
    rings = Annuli(edges)
    found = {r["annulus_id"]: r for r in ring_limits(with_ring(cells, rings), sigma).collect()}
    pick = lambda c: tuple(found[k][c] if k in found else None for k in range(len(edges)))
    return Annuli(edges, pick("ci_lower"), pick("ci_upper"))


def with_ring(cells: DataFrame, annuli: Annuli) -> DataFrame:
    return cells.withColumn("annulus_id", annuli.ring(F.col("radius"), F.col("median")))
