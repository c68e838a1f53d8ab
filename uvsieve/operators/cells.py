"""Aggregates of grid cells. Rows: (u_bin, v_bin, newrow, value); grids are sparse: (u_bin, v_bin, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.thresholds import MAD_SCALE
from ..sources.checkpoints import settled
from .selection import quantiles, sent

CELL = ["u_bin", "v_bin"]
#: Rows of a cell beyond which its median isn't taken from one aggregation buffer.
HOT_ROWS = 200_000


def usable(rows: DataFrame, keep_flagged: bool = False) -> DataFrame:
    """Rows that count: unflagged (unless ``keep_flagged``) and not zero."""
    return (rows if keep_flagged else rows.where(~F.col("flag"))).where(F.col("value") != 0)


def null_rows(rows: DataFrame, keep_flagged: bool = False) -> DataFrame:
    """Rows of value zero, which count as flagged."""
    return (rows if keep_flagged else rows.where(~F.col("flag"))).where(F.col("value") == 0)


def _any_hot(rows: DataFrame, keys: list[str], value: str, hot: int) -> bool:
    """Whether a group has more than ``hot`` rows: one aggregate of counts, of which a number comes back."""
    return (rows.groupBy(*keys).agg(F.count(value).alias("_n")).agg(F.max("_n")).first()[0] or 0) > hot


def medians(rows: DataFrame, keys: list[str] = CELL, value: str = "value", hot: int = HOT_ROWS, split: bool | None = None) -> DataFrame:
    """(keys, median): the exact median of each group, the mean of the middle pair where the count is even.

    Groups of up to ``hot`` rows are one aggregate; in a larger one the median is selected (``selection.quantiles``). ``split``: whether there is a larger one, if that is known."""
    if split is None:
        split = _any_hot(rows, keys, value, hot)
    return _split_medians(rows, keys, value, hot) if split else rows.groupBy(*keys).agg(F.median(value).alias("median"))


def _split_medians(rows: DataFrame, keys: list[str], value: str, hot: int) -> DataFrame:
    sizes = settled(rows.groupBy(*keys).agg(F.count(value).alias("_n")))
    plain = rows.join(sizes.where(F.col("_n") <= hot).select(*keys), keys, "left_semi").groupBy(*keys).agg(F.median(value).alias("median"))
    large = quantiles(rows.join(sent(sizes.where(F.col("_n") > hot).select(*keys)), keys, "left_semi"), keys, value, limit=hot)
    return plain.unionByName(large.select(*keys, F.col("q0").alias("median")))


def quantile_grid(rows: DataFrame, at: tuple[float, ...], hot: int = HOT_ROWS) -> DataFrame:
    """(u_bin, v_bin, q0, q1, ...): exact quantiles of each cell, between two values in proportion; selected where there is a cell beyond ``hot`` rows."""
    if _any_hot(rows, CELL, "value", hot):
        return quantiles(rows, CELL, at=at, limit=hot).drop("n")
    found = rows.groupBy(*CELL).agg(F.percentile("value", F.array(*[F.lit(float(q)) for q in at])).alias("_q"))
    return found.select(*CELL, *[F.col("_q")[k].alias(f"q{k}") for k in range(len(at))])


def median_grid(rows: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    return medians(usable(rows), hot=hot)


def cell_stats(rows: DataFrame, hot: int = HOT_ROWS, split: bool | None = None) -> DataFrame:
    """(u_bin, v_bin, n, mean, median) of rows that are to be counted: one shuffle, unless a cell is too large for one buffer."""
    sums = [F.count("*").alias("n"), F.avg("value").alias("mean")]
    if split is None:
        split = _any_hot(rows, CELL, "value", hot)
    if not split:
        return rows.groupBy(*CELL).agg(*sums, F.median("value").alias("median"))
    return rows.groupBy(*CELL).agg(*sums).join(_split_medians(rows, CELL, "value", hot), CELL)


def mad_grid(rows: DataFrame, scale: float = MAD_SCALE, hot: int = HOT_ROWS) -> DataFrame:
    """(u_bin, v_bin, mad): scaled median absolute deviation. The rows are settled once, sized once, and read twice more."""
    rows = settled(rows.select(*CELL, "value"))
    split = _any_hot(rows, CELL, "value", hot)
    apart = _apart(rows, medians(rows, hot=hot, split=split))
    return medians(apart, value="apart", hot=hot, split=split).select(*CELL, (F.col("median") * scale).alias("mad"))


def _apart(rows: DataFrame, centre: DataFrame) -> DataFrame:
    """Rows with how far they are from their cell's median."""
    return rows.join(centre.select(*CELL, F.col("median").alias("_m")), CELL).withColumn("apart", F.abs(F.col("value") - F.col("_m")))


def rms_grid(rows: DataFrame, normalised: bool = False, hot: int = HOT_ROWS) -> DataFrame:
    """(u_bin, v_bin, rms): the root of the summed squares about the median; ``normalised``: of their mean."""
    rows = settled(rows.select(*CELL, "value"))
    square = F.col("apart") * F.col("apart")
    return _apart(rows, medians(rows, hot=hot)).groupBy(*CELL).agg(F.sqrt((F.avg if normalised else F.sum)(square)).alias("rms"))


def apply_grid(rows: DataFrame, name: str, function) -> DataFrame:
    """(u_bin, v_bin, name): any aggregate - a function of a column, built in or a grouped pandas UDF."""
    return rows.groupBy(*CELL).agg(function(F.col("value")).alias(name))


def members(rows: DataFrame, *columns: str, width: int = 100_000) -> DataFrame:
    """(u_bin, v_bin, place, newrow, ...): the cell's rows in order of newrow, numbered from 1, a row each. A cell is cut into ranges of ``width``
    newrows: the ranges' running sums are added, and only within a range is there a window, so that no cell meets in one task."""
    placed = rows.select(*CELL, "newrow", *columns).withColumn("_block", F.floor(F.col("newrow") / width))
    sizes = placed.groupBy(*CELL, "_block").agg(F.count("*").alias("_n"))
    starts = sizes.select(*CELL, "_block", (F.sum("_n").over(Window.partitionBy(*CELL).orderBy("_block")) - F.col("_n")).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*CELL, "_block").orderBy("newrow"))
    return placed.withColumn("_within", within).join(starts, [*CELL, "_block"]).select(*CELL, (F.col("_start") + F.col("_within")).alias("place"), "newrow", *columns)


def index_ranges(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CELL).agg(F.min("newrow").alias("first_row"), F.max("newrow").alias("last_row"))


def row_map(rows: DataFrame) -> DataFrame:
    """(u_bin, v_bin, start, stop): each cell's run in the order (u_bin, v_bin, newrow). Running sums are over the cells of a u_bin, and over the u_bins."""
    counts = rows.groupBy(*CELL).agg(F.count("*").alias("_n"))
    wide = counts.groupBy("u_bin").agg(F.sum("_n").alias("_w"))
    before = wide.select("u_bin", (F.sum("_w").over(Window.orderBy("u_bin")) - F.col("_w")).alias("_before"))  # a row per bin of one axis
    within = F.sum("_n").over(Window.partitionBy("u_bin").orderBy("v_bin").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_within", within).join(before, "u_bin").select(*CELL, (F.col("_before") + F.col("_within") - F.col("_n")).alias("start"), (F.col("_before") + F.col("_within")).alias("stop"))


def summary(rows: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """(u_bin, v_bin, n, mean, median, std, mad, ratio) in one row per cell. The rows are settled once, sized once, and read twice more."""
    rows = settled(rows.select(*CELL, "value"))
    split = _any_hot(rows, CELL, "value", hot)
    stats = settled(cell_stats(rows, hot, split))
    apart = _apart(rows, stats)
    if split:
        spread = apart.groupBy(*CELL).agg(F.stddev_pop("value").alias("std")).join(medians(apart, value="apart", hot=hot, split=True).withColumnRenamed("median", "mad"), CELL)
    else:
        spread = apart.groupBy(*CELL).agg(F.stddev_pop("value").alias("std"), F.median("apart").alias("mad"))
    return stats.join(spread, CELL).withColumn("mad", F.col("mad") * MAD_SCALE).withColumn("ratio", F.try_divide("mean", "median"))


def spreads(rows: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """(u_bin, v_bin, n, median, std). The rows are settled and sized once; without a hot cell one more aggregate does."""
    rows = settled(rows.select(*CELL, "value"))
    sums = [F.count("*").alias("n"), F.stddev_pop("value").alias("std")]
    if not _any_hot(rows, CELL, "value", hot):
        return rows.groupBy(*CELL).agg(*sums, F.median("value").alias("median"))
    return rows.groupBy(*CELL).agg(*sums).join(_split_medians(rows, CELL, "value", hot), CELL)


def remove_zero_values(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with positive values, and those of value zero (flagged); negative ones are in neither."""
    return rows.where(F.col("value") > 0), rows.where(F.col("value") == 0)


def nonzero_rows(rows: DataFrame, values: str = "values") -> DataFrame:
    """Rows whose array of values does not sum to zero."""
    return rows.where(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) != 0)


def cells_within(grid: DataFrame, u: tuple[int, int], v: tuple[int, int]) -> DataFrame:
    return grid.where(F.col("u_bin").between(*u) & F.col("v_bin").between(*v))


def flag_share(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(n, flagged, percent) of rows, over all or by the given columns."""
    found = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"))
    return found.withColumn("percent", F.try_divide(F.lit(100.0) * F.col("flagged"), F.col("n")))


def named_union(grids: dict[str, DataFrame], value: dict[str, str]) -> DataFrame:
    """(name, u_bin, v_bin, value) of several grids."""
    return reduce(DataFrame.unionByName, [g.select(F.lit(n).alias("name"), *CELL, F.col(value[n]).alias("value")) for n, g in grids.items()])


def partition_sizes(rows: DataFrame, levels: int = 3) -> DataFrame:
    """(leaf, n): rows split at the median of u_bin, then v_bin, in turn, ``levels`` times. Leaves are counted on the cells, weighted by rows."""
    parts = rows.groupBy(*CELL).agg(F.count("*").alias("_n")).withColumn("leaf", F.lit(0))
    for level in range(levels):
        axis = CELL[level % 2]
        parts = parts.join(_weighted_pivots(parts, axis), "leaf").select(*CELL, "_n", (F.col("leaf") * 2 + (F.col(axis) > F.col("pivot")).cast("int")).alias("leaf"))
    return parts.groupBy("leaf").agg(F.sum("_n").alias("n"))


def _weighted_pivots(parts: DataFrame, axis: str) -> DataFrame:
    """(leaf, pivot): the least value of ``axis`` that half of a leaf's rows do not exceed."""
    counts = parts.groupBy("leaf", axis).agg(F.sum("_n").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy("leaf").orderBy(axis))
    whole = F.sum("_m").over(Window.partitionBy("leaf"))
    return counts.withColumn("_u", upto).withColumn("_w", whole).where(F.col("_u") * 2 >= F.col("_w")).groupBy("leaf").agg(F.min(axis).alias("pivot"))

