"""The registered queries over the derived observation, each in a few lines on the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import formats, geometry, thresholds
from ..functions.stokes import stokes_flag, stokes_value
from ..operators import aggregates, annuli, baselines, cells, clipping, distributions, flags, loading, profiles, summary
from ..sources import fixtures, storage
from ..sources.checkpoints import settled, shared_folder
from ..sources.observation import DerivedObservation, Observation
from .oracle import ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]
FACTOR, SIGMA, RINGS = 0.2, 3.0, 10
CELL = cells.CELL
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def six(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or name)


# what several queries start from


def vis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.visibilities(spark, sf_dir).withColumn("value", F.col("amp"))


def planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, geometry.Grid]:
    rows = vis(spark, sf_dir)
    return rows, geometry.plan_grid(rows, diameter=fixtures.DIAMETER, factor=FACTOR)


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, grid = planned(spark, sf_dir)
    return grid.binned(rows).select(*CELL, "newrow", "value", "flag", "u", "v")


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.usable(binned(spark, sf_dir)).select(*CELL, "newrow", "value")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, grid = planned(spark, sf_dir)
    return annuli.with_radius(cells.cell_stats(cells.usable(grid.binned(rows))), grid)


def ringed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = placed(spark, sf_dir)
    return annuli.with_ring(found, annuli.plan_annuli(found, RINGS, SIGMA))


def flagging(spark: SparkSession, sf_dir: str) -> flags.Flagging:
    rows, grid = planned(spark, sf_dir)
    return flags.flag_outliers(rows, grid, sigma=SIGMA, n_annuli=RINGS)


_OBSERVED: dict[tuple[str, str], Observation] = {}


def observed(spark: SparkSession, sf_dir: str) -> Observation:
    """The derived observation as it is stored in the shared folder; written once by each application for each folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OBSERVED:
        _OBSERVED[key] = storage.store(DerivedObservation(spark, sf_dir), shared_folder(spark))
    return _OBSERVED[key]


def long_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observed(spark, sf_dir)
    return loading.flatten(o.main, o.descriptions, o.windows)


def long_grid(spark: SparkSession, sf_dir: str) -> geometry.Grid:
    """The grid that the whole observation and all its windows span."""
    o = observed(spark, sf_dir)
    return geometry.physical_grid(geometry.observation_limits(o.main, o.windows), diameter=fixtures.DIAMETER, factor=FACTOR)


def long_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long rows with Stokes I, its flag, and cells."""
    return long_grid(spark, sf_dir).binned(long_rows(spark, sf_dir).select("*", stokes_value(F.col("data"), "I").alias("value"), stokes_flag(F.col("flag"), "I").alias("flag_i")))


def found_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag ids that flagging Stokes I of the long rows finds, with their places."""
    rows = long_rows(spark, sf_dir).select("newrow", "ddid", "row", "chan", "u", "v", stokes_value(F.col("data"), "I").alias("value"), stokes_flag(F.col("flag"), "I").alias("flag"))
    return flags.flag_outliers(rows, long_grid(spark, sf_dir), sigma=SIGMA, n_annuli=RINGS, carry=("ddid", "row", "chan")).flagged_rows()


# finding interference


@query
def flag_visibilities(spark, sf_dir):
    return flagging(spark, sf_dir).flagged_rows()


@query
def flag_rows(spark, sf_dir):
    return flagging(spark, sf_dir).judged().where("outlier").select("newrow", *CELL, six("value"), six("lo"), six("hi"))


@query
def median_grid(spark, sf_dir):
    return cells.median_grid(binned(spark, sf_dir)).select(*CELL, six("median"))


@query
def median_grid_flagged(spark, sf_dir):
    return flagging(spark, sf_dir).median_after().select(*CELL, six("median"))


@query
def flag_count_grid(spark, sf_dir):
    return flagging(spark, sf_dir).count_grid()


@query
def bin_thresholds(spark, sf_dir):
    return flagging(spark, sf_dir).thresholds.select(*CELL, six("lo"), six("hi"), "branch")


@query
def flag_percentage(spark, sf_dir):
    run = flagging(spark, sf_dir)
    n = vis(spark, sf_dir).agg(F.count("*").alias("n"))
    return run.flagged_rows().agg(F.count("*").alias("flagged")).crossJoin(F.broadcast(n)).select("flagged", "n", F.round(100.0 * F.col("flagged") / F.col("n"), 6).alias("percent"))


# geometry


@query
def grid_spec(spark, sf_dir):
    rows = vis(spark, sf_dir)
    wide = F.floor(1 / (F.lit(1.22) * F.col("lam_max") / fixtures.DIAMETER)).cast("double")
    x = geometry.grid_limits(rows).withColumn("bw", wide)
    count = lambda a: F.floor(FACTOR * (F.col(f"{a}_hi") - F.col(f"{a}_lo")) / F.col("bw")).cast("int").alias(f"{a}_n")
    return x.select(six("u_lo"), six("u_hi"), six("v_lo"), six("v_hi"), six("bw"), count("u"), count("v"))


@query
def uv_limits(spark, sf_dir):
    return geometry.grid_limits(vis(spark, sf_dir)).select(*[six(c) for c in ("u_lo", "u_hi", "v_lo", "v_hi", "lam_min", "lam_max")])


@query
def linspace_edges(spark, sf_dir):
    _, grid = planned(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(grid.u.edges, 1)), "idx int, edge double").select("idx", six("edge"))


@query
def digitize(spark, sf_dir):
    return binned(spark, sf_dir).select("newrow", *CELL)


@query
def uv_distance(spark, sf_dir):
    return vis(spark, sf_dir).select("newrow", F.round(geometry.uv_distance(F.col("u"), F.col("v")), 6).alias("distance"))


@query
def fov(spark, sf_dir):
    width = geometry.field_of_view(F.col("lam"), F.lit(fixtures.DIAMETER))
    return vis(spark, sf_dir).groupBy("chan").agg(F.round(F.max(width), 9).alias("fov"), F.round(F.max("lam"), 9).alias("wavelength"))


@query
def angular_resolution(spark, sf_dir):
    longest = F.max(geometry.uv_distance(F.col("u"), F.col("v")))
    return vis(spark, sf_dir).agg(F.round(1 / longest * (180 / F.pi()) * 3600, 6).alias("arcsec"))


@query
def statistical_width(spark, sf_dir):
    x = geometry.grid_limits(vis(spark, sf_dir))
    return x.select(*[F.round(F.col(f"{a}_std") * 3.5 / F.pow("n", F.lit(0.25)), 6).alias(f"{a}_width") for a in "uv"])


# rows and cells


@query
def null_flags(spark, sf_dir):
    return cells.null_rows(binned(spark, sf_dir)).select("newrow")


@query
def sort_bins(spark, sf_dir):
    """A row's place in the order of cells: where its cell's run begins, and its place within."""
    rows = settled(kept(spark, sf_dir).select(*CELL, "newrow"))
    return cells.members(rows).join(cells.row_map(rows), CELL).select((F.col("start") + F.col("place")).alias("place"), "newrow")


@query
def grid_row_map(spark, sf_dir):
    return cells.row_map(kept(spark, sf_dir))


@query
def mad_grid(spark, sf_dir):
    return cells.mad_grid(kept(spark, sf_dir)).select(*CELL, six("mad"))


@query
def rms_grid(spark, sf_dir):
    return cells.rms_grid(kept(spark, sf_dir)).select(*CELL, six("rms"))


@query
def std_grid(spark, sf_dir):
    return cells.apply_grid(kept(spark, sf_dir), "std", F.stddev_pop).select(*CELL, six("std"))


@query
def cell_summary(spark, sf_dir):
    return cells.summary(kept(spark, sf_dir)).select(*CELL, "n", *[six(c) for c in ("mean", "median", "std", "mad", "ratio")])


@query
def cell_index_ranges(spark, sf_dir):
    return cells.index_ranges(kept(spark, sf_dir))


@query
def group_indices(spark, sf_dir):
    """The rows of every cell, in order, a row each."""
    return cells.members(kept(spark, sf_dir))


@query
def group_idx_val(spark, sf_dir):
    return cells.members(kept(spark, sf_dir), "value").withColumn("value", F.round("value", 6))


@query
def group_flagval(spark, sf_dir):
    return cells.members(binned(spark, sf_dir), "flag")


@query
def group_members(spark, sf_dir):
    return cells.members(binned(spark, sf_dir), "value", "flag").withColumn("value", F.round("value", 6))


@query
def amplitude_groups(spark, sf_dir):
    """Median and spread of the amplitude of complex Stokes I, by cell of the long rows."""
    rows = cells.usable(long_binned(spark, sf_dir).select(*CELL, stokes_value(F.col("data"), "I", "abs").alias("value"), F.col("flag_i").alias("flag")))
    found = cells.spreads(rows)
    return found.select(*CELL, "n", F.round("median", 3).alias("median"), F.round("std", 3).alias("std"))


@query
def rms_norm(spark, sf_dir):
    return cells.rms_grid(kept(spark, sf_dir), normalised=True).select(*CELL, six("rms"))


@query
def histogram_cell(spark, sf_dir):
    """Histograms of the cells of a block, each of its own values in bins that all share."""
    rows = cells.cells_within(kept(spark, sf_dir), (5, 7), (5, 9))
    return profiles.histogram_by(rows, CELL, 20, low=0.0, high=20.0)


@query
def histogram_ring(spark, sf_dir):
    """A histogram of the values of each ring's cells."""
    rings = ringed(spark, sf_dir).where(F.col("annulus_id").isNotNull()).select(*CELL, "annulus_id")
    return profiles.histogram_by(kept(spark, sf_dir).join(rings, CELL), ["annulus_id"], 20, low=0.0, high=20.0)


@query
def distinct_bins(spark, sf_dir):
    return binned(spark, sf_dir).agg(F.countDistinct("u_bin").alias("u_bins"), F.countDistinct("v_bin").alias("v_bins"))


@query
def existing_flags(spark, sf_dir):
    return cells.flag_share(binned(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query
def remove_zero_values(spark, sf_dir):
    rows = binned(spark, sf_dir)
    return rows.groupBy(*CELL).agg(F.count_if(F.col("value") > 0).alias("positive"), F.count_if(F.col("value") == 0).alias("zero"))


@query
def kd_partition_sizes(spark, sf_dir):
    return cells.partition_sizes(kept(spark, sf_dir), levels=2)


@query
def cells_in_range(spark, sf_dir):
    return cells.cells_within(kept(spark, sf_dir).groupBy(*CELL).agg(F.count("*").alias("n")), (5, 9), (4, 12))


@query
def limit_cells(spark, sf_dir):
    return kept(spark, sf_dir).groupBy(*CELL).agg(F.count("*").alias("n")).orderBy(*CELL).limit(90)


@query
def sample_cells(spark, sf_dir):
    return profiles.sample_rows(cells.median_grid(binned(spark, sf_dir)), 0.2, 7)


@query
def uvrange_filter(spark, sf_dir):
    return loading.within_uv(vis(spark, sf_dir), 500, 1500).select("newrow")


# annuli and thresholds


@query
def annulus_edges(spark, sf_dir):
    return annuli.edge_frame(placed(spark, sf_dir), RINGS).select("annulus_id", six("r_lo"), six("r_hi"))


@query
def annulus_assign(spark, sf_dir):
    return ringed(spark, sf_dir).select(*CELL, six("radius"), "annulus_id")


@query
def annulus_limits(spark, sf_dir):
    return annuli.ring_limits(ringed(spark, sf_dir), SIGMA).select("annulus_id", "n_cells", six("ci_lower"), six("ci_upper"))


@query
def annulus_stats_cells(spark, sf_dir):
    return profiles.ring_profile(ringed(spark, sf_dir)).select("annulus_id", "n", six("mean"), six("median"))


@query
def annulus_stats_values(spark, sf_dir):
    rings = ringed(spark, sf_dir).where(F.col("annulus_id").isNotNull()).select(*CELL, "annulus_id")
    return profiles.ring_stats(kept(spark, sf_dir).join(rings, CELL)).select("annulus_id", "n", *[six(c) for c in ("mean", "median", "mad", "low", "high")])


@query
def cells_in_annulus(spark, sf_dir):
    return ringed(spark, sf_dir).where(F.col("annulus_id") == 3).select(*CELL, six("median"))


@query
def rayleigh_thresholds(spark, sf_dir):
    grid, alpha = cells.median_grid(binned(spark, sf_dir)), F.lit(thresholds.checked_alpha(0.045))
    return grid.select(*CELL, F.round(thresholds.rayleigh_low(F.col("median"), alpha), 6).alias("lo"), F.round(thresholds.rayleigh_high(F.col("median"), alpha), 6).alias("hi"))


@query
def fixed_thresholds(spark, sf_dir):
    grid, alpha = cells.median_grid(binned(spark, sf_dir)), F.lit(thresholds.fixed_alpha(3))
    return grid.select(*CELL, F.round(thresholds.rayleigh_low(F.col("median"), alpha), 6).alias("lo"), F.round(thresholds.rayleigh_high(F.col("median"), alpha), 6).alias("hi"))


# profiles


@query
def radial_profile(spark, sf_dir):
    return profiles.radial_profile(placed(spark, sf_dir), "median", 20).select("bin", "n", six("median"), six("std"), six("centre"))


@query
def histogram(spark, sf_dir):
    return profiles.histogram(kept(spark, sf_dir), 50).select("bin", six("left"), six("right"), "n", six("density"))


@query
def fit_distributions(spark, sf_dir):
    names = ("norm_mean", "norm_std", "rayleigh_sigma", "lognorm_mean", "lognorm_std")
    return profiles.fits(kept(spark, sf_dir)).select(*[six(c) for c in names])


FITTED = ["normal", "rayleigh", "lognormal", "exponential", "weibull", "gamma"]


@query
def distribution_fits(spark, sf_dir):
    """Parameters of several distributions by maximum likelihood, some by Newton's steps."""
    rows = settled(kept(spark, sf_dir).select("value"))
    return distributions.fitted(rows, FITTED).select("name", "parameter", six("estimate"))


@query
def rice_fit(spark, sf_dir):
    return distributions.fitted(settled(kept(spark, sf_dir).select("value")), ["rice"]).select("name", "parameter", six("estimate"))


@query
def histogram_fits(spark, sf_dir):
    """The values' histogram with fitted densities beside it."""
    rows = settled(kept(spark, sf_dir).select("value"))
    fits = {n: distributions.distribution(n).fit(rows, "value") for n in ("rayleigh", "lognormal", "weibull", "gamma")}
    found = distributions.beside(profiles.histogram(rows, 40, low=0.0, high=40.0), fits)
    return found.select("bin", "n", six("density"), *[six(f"pdf_{n}") for n in fits])


@query
def rayleigh_pdf(spark, sf_dir):
    rows = kept(spark, sf_dir)
    sigma = F.broadcast(profiles.fits(rows).select("rayleigh_sigma"))  # one row
    return rows.crossJoin(sigma).select("newrow", F.round(profiles.rayleigh_density(F.col("value"), F.col("rayleigh_sigma")), 6).alias("density"))


@query
def hexbin(spark, sf_dir):
    rows = binned(spark, sf_dir).where(~F.col("flag")).withColumn("distance", geometry.uv_distance(F.col("u"), F.col("v")))
    return profiles.hexagons(rows, "distance", "value")


@query
def grid_colors(spark, sf_dir):
    grid = cells.median_grid(binned(spark, sf_dir))
    middle = grid.agg(F.median("median").alias("m"))
    top = grid.crossJoin(F.broadcast(middle)).agg((F.first("m") + 3 * thresholds.MAD_SCALE * F.median(F.abs(F.col("median") - F.col("m")))).alias("top"))
    return grid.crossJoin(F.broadcast(top)).select(*CELL, formats.heat_colour(F.col("median"), F.col("top")).alias("colour"))


# nested tables


@query
def load_binned(spark, sf_dir):
    return long_binned(spark, sf_dir).select("newrow", "ddid", "row", "chan", six("u"), six("v"), *CELL, F.round("value", 4).alias("stokes_i"), F.col("flag_i").alias("flag"))


@query
def stokes_all(spark, sf_dir):
    values = [F.round(stokes_value(F.col("data"), s), 4).alias(s.lower()) for s in "QUV"]
    return long_rows(spark, sf_dir).select("newrow", *values, stokes_flag(F.col("flag"), "U").alias("flag_uv"), stokes_flag(F.col("flag"), "A").alias("flag_any"))


@query
def amplitude(spark, sf_dir):
    return long_rows(spark, sf_dir).select("newrow", F.round(stokes_value(F.col("data"), "I", "abs"), 3).alias("amplitude"))


@query
def filter_ddid_in(spark, sf_dir):
    return long_rows(spark, sf_dir).where(F.col("ddid").isin(1)).select("newrow")


@query
def filter_field(spark, sf_dir):
    return fixtures.main_table(spark, sf_dir).where(F.col("field_id") == 2).groupBy("ddid").agg(F.count("*").alias("n"))


@query
def row_spans(spark, sf_dir):
    o = observed(spark, sf_dir)
    return loading.row_spans(o.main, o.descriptions, o.windows, o.polarizations)


@query
def ddid_by_nchan(spark, sf_dir):
    o = observed(spark, sf_dir)
    found = loading.row_bases(o.main, o.descriptions, o.windows).groupBy("nchan").agg(F.array_sort(F.collect_list(F.col("ddid").cast("string"))).alias("d"))
    return found.select("nchan", F.array_join("d", ",").alias("ddids"))


def _written(spark, sf_dir, overwrite):
    o = observed(spark, sf_dir)
    nested = loading.write_flags(o.main, o.descriptions, o.windows, found_ids(spark, sf_dir), "I", overwrite)
    long = loading.exploded_flags(nested, loading.row_bases(o.main, o.descriptions, o.windows))
    return long.select("newrow", *[F.col("flag")[k].alias(f"f{k}") for k in range(4)])


@query
def write_flags_or(spark, sf_dir):
    return _written(spark, sf_dir, False)


@query
def write_flags_overwrite(spark, sf_dir):
    return _written(spark, sf_dir, True)


def flags_as_text(nested: DataFrame) -> DataFrame:
    text = F.transform("flag", lambda c: F.array_join(F.transform(c, lambda f: f.cast("int").cast("string")), ""))
    return nested.select("ddid", "row", F.array_join(text, "/").alias("flags"))


@query
def renest_flags(spark, sf_dir):
    o = observed(spark, sf_dir)
    return flags_as_text(loading.write_flags(o.main, o.descriptions, o.windows, found_ids(spark, sf_dir)))


@query
def flags_stored(spark, sf_dir):
    """The flags of a stored table after a write-back of what flagging finds."""
    o = storage.store(DerivedObservation(spark, sf_dir), shared_folder(spark))
    o.write_back(found_ids(spark, sf_dir))
    o.tidy()
    return flags_as_text(o.main)


# storage order


def reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main table, its times cut to the hour so that baselines share them, in storage order."""
    path = shared_folder(spark)
    hourly = fixtures.main_table(spark, sf_dir).withColumn("time", F.floor(F.col("time") / 3600) * 3600)
    storage.reorder(hourly, path)
    return spark.read.parquet(path)


@query
def storage_order(spark, sf_dir):
    """Each row's place in storage order, told by where it stands in the files."""
    rows = reordered(spark, sf_dir).select(storage.MARK, "row_id")
    return storage.placed(rows, storage.numbers(rows)).select((F.col("row") + 1).alias("place"), "row_id")


@query
def storage_inversions(spark, sf_dir):
    return storage.inversions(reordered(spark, sf_dir))


# summaries


@query
def main_table_info(spark, sf_dir):
    return summary.main_info(fixtures.main_table(spark, sf_dir)).select("ddid", "n_rows", F.round("exposure", 3).alias("exposure"), "began", "ended")


@query
def scan_list(spark, sf_dir):
    o = DerivedObservation(spark, sf_dir)
    return summary.scan_list(o.main, o.fields, o.states).drop("interval")


@query
def field_list(spark, sf_dir):
    o = DerivedObservation(spark, sf_dir)
    return summary.field_list(o.main, o.fields).select("field_id", "name", "n_rows", "ra", "declination")


@query
def list_fields(spark, sf_dir):
    o = DerivedObservation(spark, sf_dir)
    return summary.field_intents(o.main, o.fields, o.states)


@query
def spectral_windows(spark, sf_dir):
    o = DerivedObservation(spark, sf_dir)
    rows = o.main.groupBy("ddid").agg(F.count("*").alias("n_rows"))
    return summary.window_list(o.descriptions, o.windows, o.polarizations).join(rows, "ddid").withColumn("centre_mhz", F.round("centre_mhz", 6))


@query
def obs_summary(spark, sf_dir):
    """The observation's summary, a row for each line."""
    return summary.summary_lines(observed(spark, sf_dir))


@query
def obs_sections(spark, sf_dir):
    """How many lines each section of the observation's summary has."""
    return summary.section_sizes(DerivedObservation(spark, sf_dir))


@query
def spw_split(spark, sf_dir):
    """The band of each description's window in parts, with the description's rows."""
    o = DerivedObservation(spark, sf_dir)
    rows = o.main.groupBy("ddid").agg(F.count("*").alias("n_rows")).join(o.descriptions, "ddid")
    return summary.split_windows(o.windows, 4).join(rows, "spw_id").select("ddid", "spw_id", "part", six("low_mhz"), six("high_mhz"), "n_rows")


@query
def antenna_list(spark, sf_dir):
    return summary.antenna_list(DerivedObservation(spark, sf_dir).antennas)


@query
def longest_baseline(spark, sf_dir):
    return summary.longest_baseline(DerivedObservation(spark, sf_dir).antennas).select(six("distance"))


@query
def longest_projections(spark, sf_dir):
    """The longest baseline that a field sees at three moments."""
    return baselines.longest_projections(observed(spark, sf_dir), 2).select("moment", F.round("wavelengths", 3).alias("wavelengths"))


@query
def spw_exclude_bad(spark, sf_dir):
    """Channels seen in the rows, 2 MHz wide, without those wholly in a bad range."""
    low, high, _ = formats.range_bounds(F.col("range"))
    bad = fixtures.bad_ranges(spark).select(low.alias("bad_low"), high.alias("bad_high"))
    centre = F.round(geometry.LIGHT / F.col("lam") / 1e6, 6)
    seen = long_rows(spark, sf_dir).groupBy("ddid", "chan").agg(F.max(centre).alias("mhz"), F.count("*").alias("n"))
    return summary.windows_outside(seen.select("ddid", "chan", "n", (F.col("mhz") - 1).alias("low"), (F.col("mhz") + 1).alias("high")), bad)


# rows, joins and sets


@query
def scan_main(spark, sf_dir):
    return fixtures.main_table(spark, sf_dir).select("row_id", "field_id", "ddid", "scan_number", six("u_m"), six("v_m"))


@query
def scan_ordered(spark, sf_dir):
    """Places in the order (scan_number, time, row_id)."""
    return summary.ordered_rows(fixtures.main_table(spark, sf_dir))


@query
def residual_column(spark, sf_dir):
    return long_rows(spark, sf_dir).select("newrow", F.round(F.col("data")[0]["re"].cast("double"), 4).alias("first_re"), F.round(F.col("data")[2]["re"].cast("double"), 4).alias("third_re"))


@query
def union_ddids(spark, sf_dir):
    return long_rows(spark, sf_dir).select("newrow", "ddid", six("u"), six("v"))


@query
def join_ddid_spw(spark, sf_dir):
    return long_rows(spark, sf_dir).groupBy("ddid", "chan", F.round("lam", 9).alias("lam")).agg(F.count("*").alias("n"))


@query
def field_lookup(spark, sf_dir):
    fields = fixtures.fields(spark, sf_dir)
    return fields.where(F.col("field_id") == loading.field_by_name(fields, "ASIA")).select("field_id", "name")


@query
def source_list(spark, sf_dir):
    return summary.source_list(DerivedObservation(spark, sf_dir).sources)


@query
def sources_stored(spark, sf_dir):
    """The source list of a written observation of which one file lacks the optional columns."""
    folder, whole = shared_folder(spark), DerivedObservation(spark, sf_dir).sources
    whole.where("source_id < 2").write.parquet(f"{folder}/source.parquet")
    whole.where("source_id >= 2").drop("rest_frequency", "sysvel").write.mode("append").parquet(f"{folder}/source.parquet")
    return summary.source_list(Observation(spark, folder).sources)


@query
def observation_info(spark, sf_dir):
    return fixtures.observations(spark, sf_dir).select("observer", "project", "telescope_name", F.date_format("began", "dd-MMM-yyyy HH:mm:ss").alias("began"), F.date_format("ended", "dd-MMM-yyyy HH:mm:ss").alias("ended"))


@query
def spw_bounds(spark, sf_dir):
    """Frequency ranges as text, one made from each antenna's number, read back."""
    k = F.col("antenna_id")
    text = F.concat(F.when(k % 2 == 0, "0:").otherwise(""), (k + 880).cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("~"), (k + 933).cast("string"))), F.lit("MHz"))
    low, high, unit = formats.range_bounds(F.col("text"))
    given = DerivedObservation(spark, sf_dir).antennas.select(text.alias("text"))
    return given.select("text", low.alias("low"), high.alias("high"), unit.alias("unit"))


@query
def cell_runs(spark, sf_dir):
    """Each cell's run and where the next one begins: where it stops itself, but for the last."""
    runs = cells.row_map(kept(spark, sf_dir))
    end = runs.agg(F.max("stop").alias("end"))  # one row
    return runs.crossJoin(F.broadcast(end)).select(*CELL, "start", F.when(F.col("stop") < F.col("end"), F.col("stop")).alias("next_start"))


@query
def cell_limits(spark, sf_dir):
    found = placed(spark, sf_dir)
    rings = annuli.plan_annuli(found, RINGS, SIGMA)
    upper = rings.limit(F.col("annulus_id"))
    doubted = F.coalesce(F.col("median") > upper, F.lit(False)) | F.coalesce(F.try_divide("mean", "median") > flags.DOUBTFUL, F.lit(False))
    return annuli.with_ring(found, rings).select(*CELL, F.round(upper, 6).alias("ci_upper"), doubted.alias("doubted"))


@query
def bin_counts(spark, sf_dir):
    return kept(spark, sf_dir).groupBy(*CELL).agg(F.count("*").alias("n"))


@query
def group_values(spark, sf_dir):
    return cells.members(kept(spark, sf_dir), "value").select(*CELL, "place", F.round(F.col("value") * 1000).cast("bigint").alias("thousandths"))


@query
def amplitude_median_std(spark, sf_dir):
    rows = kept(spark, sf_dir).withColumn("value", F.abs("value"))
    return cells.medians(rows).join(cells.apply_grid(rows, "std", F.stddev_pop), CELL).select(*CELL, six("median"), six("std"))


@query
def apply_fn(spark, sf_dir):
    return cells.apply_grid(kept(spark, sf_dir), "extent", lambda v: F.max(v) - F.min(v)).select(*CELL, six("extent"))


@query
def cell_trimmed_mean(spark, sf_dir):
    """A user's aggregate: the mean of a cell's values from its first decile to its last."""
    rows = settled(kept(spark, sf_dir).select(*CELL, "value"))
    ends = cells.quantile_grid(rows, (0.1, 0.9)).select(*CELL, (F.col("q0") - 1e-9).alias("low"), (F.col("q1") + 1e-9).alias("high"))  # whatever the last digit of a quantile
    means = aggregates.aggregate(rows.join(ends, CELL), CELL, aggregates.TrimmedMean(), "mean")
    return means.where(~F.isnan("mean")).select(*CELL, six("mean"))  # two values alone have none between their deciles


@query
def null_flags_multi(spark, sf_dir):
    rows = binned(spark, sf_dir).where(~F.col("flag")).withColumn("values", F.array(F.col("value"), F.col("u") * 0))
    return rows.join(cells.nonzero_rows(rows).select("newrow"), "newrow", "left_anti").select("newrow")


@query
def hist_range(spark, sf_dir):
    return profiles.histogram(kept(spark, sf_dir), 20, low=2.0, high=12.0).select("bin", "n")


@query
def histogram_weighted(spark, sf_dir):
    return profiles.histogram(kept(spark, sf_dir), 20, low=2.0, high=12.0, weight="value").select("bin", F.round("n", 5).alias("n"))


@query
def rayleigh_clip_upper(spark, sf_dir):
    rows = kept(spark, sf_dir)
    doubtful = cells.cell_stats(rows).where(F.try_divide("mean", "median") > flags.DOUBTFUL)
    high = thresholds.rayleigh_high(F.col("median"), F.lit(0.045))
    return rows.join(doubtful.select(*CELL, high.alias("high")), CELL).groupBy(*CELL).agg(F.count_if(F.col("value") < F.col("high")).alias("n_left"))


@query
def sigma_clip(spark, sf_dir):
    rows = settled(kept(spark, sf_dir).select(*CELL, "value"))
    left = clipping.within(rows, clipping.clip_groups(rows, SIGMA))
    return left.groupBy(*CELL).agg(F.count("*").alias("n_left"), F.round(F.avg("value"), 6).alias("mean"))


@query
def sigma_clip_median(spark, sf_dir):
    """Clipping about the median, four spreads below it and three above."""
    rows = settled(kept(spark, sf_dir).select(*CELL, "value"))
    left = clipping.within(rows, clipping.clip_groups(rows, 4.0, high_sigma=3.0, centre="median"))
    return left.groupBy(*CELL).agg(F.count("*").alias("n_left"), F.round(F.avg("value"), 6).alias("mean"))


@query
def semi_flagged(spark, sf_dir):
    return vis(spark, sf_dir).join(flagging(spark, sf_dir).flagged_rows(), "newrow", "left_semi").groupBy("chan").agg(F.count("*").alias("n"))


@query
def anti_flagged(spark, sf_dir):
    return vis(spark, sf_dir).join(flagging(spark, sf_dir).flagged_rows(), "newrow", "left_anti").groupBy("chan").agg(F.count("*").alias("n"))


@query
def apply_flags(spark, sf_dir):
    ids = flagging(spark, sf_dir).flagged_rows().select("newrow", F.lit(True).alias("hit"))
    return vis(spark, sf_dir).join(ids, "newrow", "left").select("newrow", F.coalesce("hit", F.lit(False)).alias("flagged"))


@query
def radial_annulus_profile(spark, sf_dir):
    run = flagging(spark, sf_dir)
    both = cells.named_union({"before": run.cells, "after": run.median_after()}, {"before": "median", "after": "median"})
    rings = run.cells.where(F.col("annulus_id").isNotNull()).select(*CELL, "annulus_id")
    return both.join(rings, CELL).groupBy("name", "annulus_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


__all__ = ["QUERIES", "ORACLE_SQL"]
