"""Finding outliers: cell thresholds and flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Grid
from ..functions.thresholds import rayleigh_high, rayleigh_low
from ..sources.checkpoints import settled
from .annuli import Annuli, plan_annuli, with_radius, with_ring
from .cells import CELL, HOT_ROWS, cell_stats, medians, null_rows, usable
from .clipping import clip_groups, within

#: A mean over median beyond which a cell isn't trusted, and isn't kept.
DOUBTFUL, HOPELESS = 1.2, 1.4


def cell_thresholds(rows: DataFrame, cells: DataFrame, annuli: Annuli, sigma: float = 3.0, hot: int = HOT_ROWS) -> DataFrame:
    """(u_bin, v_bin, lo, hi, branch) for every cell of ``cells(u_bin, v_bin, n, mean, median, annulus_id)``.

    branch: trusted; recovered (its upper part cut, then trusted); empty or dropped (both bounds 0: everything goes)."""
    limit = annuli.limit(F.col("annulus_id"))
    doubt = F.coalesce(F.col("median") > F.col("cu"), F.lit(False)) | F.coalesce(F.try_divide("mean", "median") > DOUBTFUL, F.lit(False))
    known = settled(cells.withColumn("cu", limit).withColumn("alpha", F.lit(0.5) / F.col("n")).withColumn("doubted", doubt))
    trusted = known.where(~F.col("doubted")).select(*CELL, "median", "alpha", F.lit("trusted").alias("branch"))
    doubted = known.where("doubted").select(*CELL, "alpha", "cu", rayleigh_high(F.col("cu"), F.col("alpha")).alias("cut"))
    # an annulus without limits cuts everything, as a comparison with no number does
    lower = settled(rows.join(doubted.select(*CELL, "cut"), CELL).where(F.col("value") < F.col("cut")).select(*CELL, "value"))
    first = settled(cell_stats(lower, hot=hot))
    skewed = first.where(F.try_divide("mean", "median") > HOPELESS).select(*CELL)
    if skewed.limit(1).count():
        rest = within(lower, clip_groups(lower.join(skewed, CELL, "left_semi"), sigma, hot=hot)).select(*CELL, "value")
        second = first.join(skewed, CELL, "left_anti").unionByName(cell_stats(rest, hot=hot))
    else:
        second = first
    judged = doubted.join(second.select(*CELL, "mean", "median"), CELL, "left")
    hopeless = F.coalesce(F.col("median") > F.col("cu"), F.lit(False)) | F.coalesce(F.try_divide("mean", "median") > HOPELESS, F.lit(False))
    branch = F.when(F.col("median").isNull(), "empty").when(hopeless, "dropped").otherwise("recovered")
    every = trusted.unionByName(judged.select(*CELL, "median", "alpha", branch.alias("branch")))
    gone = F.col("branch").isin("empty", "dropped")
    return every.select(
        *CELL, F.when(gone, 0.0).otherwise(rayleigh_low(F.col("median"), F.col("alpha"))).alias("lo"),
        F.when(gone, 0.0).otherwise(rayleigh_high(F.col("median"), F.col("alpha"))).alias("hi"), "branch",
    )


@dataclass(frozen=True)
class Flagging:
    """The parts of a flagging run."""

    rows: DataFrame  # usable rows, binned
    nulls: DataFrame  # rows of value zero
    cells: DataFrame  # u_bin, v_bin, n, mean, median, radius, annulus_id
    annuli: Annuli
    thresholds: DataFrame
    carry: tuple[str, ...] = ()  # columns of the rows that come along to the flags

    def judged(self) -> DataFrame:
        """Usable rows with lo, hi and whether they are outliers. Values on a bound are."""
        return self.rows.join(self.thresholds, CELL).withColumn("outlier", (F.col("value") <= F.col("lo")) | (F.col("value") >= F.col("hi")))

    def flagged_rows(self) -> DataFrame:
        """(newrow, carry, reason): outliers and zeros."""
        names = ["newrow", *self.carry]
        return self.judged().where("outlier").select(*names, F.lit("threshold").alias("reason")).unionAll(self.nulls.select(*names, F.lit("zero").alias("reason")))

    def count_grid(self) -> DataFrame:
        return self.judged().groupBy(*CELL).agg(F.count_if("outlier").alias("flagged"))

    def median_after(self) -> DataFrame:
        """(u_bin, v_bin, median) of the rows left; 0 where none is."""
        judged = self.judged()
        left = medians(judged.where(~F.col("outlier")).select(*CELL, "value"))
        return self.cells.select(*CELL).join(left, CELL, "left").select(*CELL, F.coalesce("median", F.lit(0.0)).alias("median"))


def flag_outliers(visibilities: DataFrame, grid: Grid, *, sigma: float = 3.0, n_annuli: int = 10, use_existing_flags: bool = True, hot: int = HOT_ROWS, carry: tuple[str, ...] = ()) -> Flagging:
    """Finds outliers of ``visibilities(newrow, u, v, value, flag)``.

    Rows already flagged take no part, unless ``use_existing_flags`` is false. Columns named in ``carry``, such as ddid, row and chan, come along to the flags. The narrow binned rows and the cells' statistics are settled once and read
    where they are needed."""
    binned = settled(grid.binned(visibilities).select(*CELL, "newrow", *carry, "value", "flag"))
    rows = usable(binned, not use_existing_flags).drop("flag")
    cells = settled(with_radius(cell_stats(rows, hot=hot), grid))
    annuli = plan_annuli(cells, n_annuli, sigma)
    ringed = with_ring(cells, annuli)
    return Flagging(rows, null_rows(binned, not use_existing_flags).drop("flag"), ringed, annuli, settled(cell_thresholds(rows, ringed, annuli, sigma, hot)), carry)
