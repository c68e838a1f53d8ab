"""Observation summaries from the main table and its dimension tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.formats import clock, correlation_names, degrees_minutes_seconds, hours_minutes_seconds

#: Fixed values of the WGS84 ellipsoid: equatorial radius in m and flattening.
EARTH_RADIUS, FLATTENING = 6_378_137.0, 1 / 298.257223563


def main_info(main: DataFrame) -> DataFrame:
    """A row per description: rows, exposure in seconds, when it began and ended."""
    found = main.groupBy("ddid").agg(F.count("*").alias("n_rows"), F.min("time").alias("t0"), F.max("time").alias("t1"), F.max_by("observation_id", "time").alias("observation_id"), F.max_by("array_id", "time").alias("array_id"))
    return found.select("ddid", "n_rows", (F.col("t1") - F.col("t0")).alias("exposure"), clock(F.col("t0")).alias("began"), clock(F.col("t1")).alias("ended"), "observation_id", "array_id")


def scan_list(main: DataFrame, fields: DataFrame, states: DataFrame) -> DataFrame:
    """A row per scan and field, with the field's name and the intent ('' where there is no state)."""
    found = main.groupBy("scan_number", "field_id").agg(
        F.count("*").alias("n_rows"), F.min("time").alias("t0"), F.max("time").alias("t1"), F.round(F.max_by("interval", F.struct("time", "row_id")), 2).alias("interval"), F.min_by("state_id", F.struct("time", "row_id")).alias("state_id")
    )
    named = found.join(fields.select("field_id", F.col("name").alias("field_name")), "field_id").join(states, "state_id", "left")
    return named.select("scan_number", "field_id", "field_name", clock(F.col("t0")).alias("began"), clock(F.col("t1")).alias("ended"), "n_rows", "interval", F.coalesce("obs_mode", F.lit("")).alias("intent"))


def field_list(main: DataFrame, fields: DataFrame) -> DataFrame:
    counts = main.groupBy("field_id").agg(F.count("*").alias("n_rows"))
    direction = F.col("reference_dir")[0]
    return fields.join(counts, "field_id", "left").select(
        "field_id", "code", "name", hours_minutes_seconds(direction[0]).alias("ra"), degrees_minutes_seconds(F.degrees(direction[1])).alias("declination"), F.lit("J2000").alias("epoch"), "source_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def field_intents(main: DataFrame, fields: DataFrame, states: DataFrame) -> DataFrame:
    """(field_id, name, intent): the intent of each field's last scan."""
    last = main.groupBy("field_id").agg(F.max_by("state_id", F.struct("scan_number", "time", "row_id")).alias("state_id"))
    return fields.join(last, "field_id", "left").join(states, "state_id", "left").select("field_id", "name", F.coalesce("obs_mode", F.lit("")).alias("intent"))


def window_list(descriptions: DataFrame, windows: DataFrame, polarizations: DataFrame) -> DataFrame:
    """A row per description: channels, first channel, channel width, bandwidth, centre, correlations."""
    return descriptions.join(windows, "spw_id").join(polarizations, "polarization_id").select(
        "ddid", "spw_id", "name", F.size("chan_freq").alias("n_chan"), (F.col("chan_freq")[0] / 1e6).alias("first_mhz"), (F.col("chan_width")[0] / 1e3).alias("width_khz"), (F.col("total_bandwidth") / 1e3).alias("bandwidth_khz"),
        ((F.array_min("chan_freq") + F.array_max("chan_freq")) / 2e6).alias("centre_mhz"), correlation_names(F.col("corr_type")).alias("correlations"),
    )


def source_list(sources: DataFrame) -> DataFrame:
    """(source_id, name, spw_id, rest_frequency, system_velocity); 0 where a column is missing."""
    optional = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(0.0)) if c in sources.columns else F.lit(0.0)
    return sources.select("source_id", "name", "spw_id", optional("rest_frequency").alias("rest_frequency"), optional("sysvel").alias("system_velocity"))


def geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude and latitude in degrees and height in m of a geocentric position, by Bowring's closed form."""
    a, f = EARTH_RADIUS, FLATTENING
    b, e2 = a * (1 - f), f * (2 - f)
    second = e2 / (1 - e2)
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * a, p * b)
    lat = F.atan2(z + second * b * F.pow(F.sin(t), 3), p - e2 * a * F.pow(F.cos(t), 3))
    n = F.lit(a) / F.sqrt(1 - e2 * F.pow(F.sin(lat), 2))
    height = p * F.cos(lat) + z * F.sin(lat) - F.lit(a * a) / n
    return F.degrees(F.atan2(y, x)), F.degrees(lat), height


def antenna_list(antennas: DataFrame) -> DataFrame:
    p = F.col("position")
    lon, lat, height = geodetic(p[0], p[1], p[2])
    return antennas.select("antenna_id", "name", "station", "dish_diameter", p[0].alias("x"), p[1].alias("y"), p[2].alias("z"), lon.alias("longitude"), lat.alias("latitude"), height.alias("height"))


def longest_baseline(antennas: DataFrame) -> DataFrame:
    """The greatest distance between two antennas, of any number.

    The antenna farthest from the first one, and the one farthest from that, are ``reach`` apart. From the middle between them no antenna is
    farther than ``most``; so an end of a longer baseline is at least ``reach`` - ``most`` from it, and only such antennas are held against each other."""
    p = antennas.select("antenna_id", *[F.col("position")[k].alias(c) for k, c in enumerate("xyz")])

    def apart(a, b) -> Column:
        return F.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)))

    def farthest(point) -> tuple | None:
        row = p.select("antenna_id", *"xyz", apart([F.col(c) for c in "xyz"], [F.lit(v) for v in point]).alias("d")).orderBy(F.desc("d"), "antenna_id").first()
        return row and (row["x"], row["y"], row["z"], row["d"])

    one = farthest((0.0, 0.0, 0.0))
    if one is None:
        return p.agg(F.max(F.lit(0.0)).alias("distance"))
    other = farthest(one[:3])
    middle = [(a + b) / 2 for a, b in zip(one[:3], other[:3], strict=True)]
    out = apart([F.col(c) for c in "xyz"], [F.lit(m) for m in middle])
    most = farthest(middle)[3]
    ends = p.where(out >= other[3] - most - 1e-6 * max(most, 1.0))
    a, b = ends.toDF("first", "x1", "y1", "z1"), ends.toDF("second", "x2", "y2", "z2")
    pairs = a.join(b, F.col("first") < F.col("second"))
    return pairs.agg(F.max(apart([F.col(f"{c}1") for c in "xyz"], [F.col(f"{c}2") for c in "xyz"])).alias("distance"))


def ordered_rows(main: DataFrame, width: float = 600.0) -> DataFrame:
    """(place, row_id) in the order (scan_number, time, row_id). Rows are counted by scan and by ``width`` seconds of time; a scan begins where the ones before it end, a
    range where the ranges of its scan before it end, and only within a range is there a window."""
    rows = main.select("scan_number", "time", "row_id", F.floor(F.col("time") / width).alias("_range"))
    counts = rows.groupBy("scan_number", "_range").agg(F.count("*").alias("_n"))
    scans = counts.groupBy("scan_number").agg(F.sum("_n").alias("_m"))
    begins = scans.select("scan_number", (F.sum("_m").over(Window.orderBy("scan_number")) - F.col("_m")).alias("_scan"))  # a row per scan
    starts = counts.join(begins, "scan_number").select("scan_number", "_range", (F.col("_scan") + F.sum("_n").over(Window.partitionBy("scan_number").orderBy("_range")) - F.col("_n")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("scan_number", "_range").orderBy("time", "row_id"))
    return rows.withColumn("_within", within).join(starts, ["scan_number", "_range"]).select((F.col("_start") + F.col("_within")).alias("place"), "row_id")


def windows_outside(windows: DataFrame, bad: DataFrame) -> DataFrame:
    """``windows(name, low, high)`` that don't lie wholly within a ``bad(bad_low, bad_high)`` range (a short, given list)."""
    return windows.join(bad, (F.col("low") >= F.col("bad_low")) & (F.col("high") <= F.col("bad_high")), "left_anti")


def split_windows(windows: DataFrame, n: int) -> DataFrame:
    """(spw_id, part, low_mhz, high_mhz): the band of each window in ``n`` parts of equal width."""
    low, band = F.col("chan_freq")[0] / 1e6, F.col("total_bandwidth") / 1e6
    parts = windows.select("spw_id", low.alias("_low"), (band / n).alias("_wide"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"))
    return parts.select("spw_id", "part", (F.col("_low") + F.col("part") * F.col("_wide")).alias("low_mhz"), (F.col("_low") + (F.col("part") + 1) * F.col("_wide")).alias("high_mhz"))


def observation_summary(observation) -> dict[str, DataFrame]:
    """All lists of an ``Observation`` by name, each a DataFrame; nothing is collected."""
    o = observation
    return {
        "main": main_info(o.main), "scans": scan_list(o.main, o.fields, o.states), "fields": field_list(o.main, o.fields), "intents": field_intents(o.main, o.fields, o.states),
        "sources": source_list(o.sources), "windows": window_list(o.descriptions, o.windows, o.polarizations), "antennas": antenna_list(o.antennas),
    }


#: What a line of each section shows.
LINES = {
    "main": ("ddid", "n_rows", "began", "ended"), "scans": ("scan_number", "field_name", "began", "ended", "n_rows", "intent"), "fields": ("field_id", "code", "name", "ra", "declination", "epoch", "n_rows"),
    "intents": ("field_id", "name", "intent"), "sources": ("source_id", "name", "spw_id"), "windows": ("ddid", "spw_id", "name", "n_chan", "correlations"), "antennas": ("antenna_id", "name", "station"),
}


def summary_lines(observation) -> DataFrame:
    """(section, line): the lists of an observation as text, their values parted by bars; nothing is collected."""
    found = observation_summary(observation)
    text = lambda names: F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    return reduce(DataFrame.unionByName, [found[name].select(F.lit(name).alias("section"), text(names).alias("line")) for name, names in LINES.items()])


def section_sizes(observation) -> DataFrame:
    """(section, n_rows) of an observation's summary."""
    found = observation_summary(observation)
    return reduce(DataFrame.unionByName, [lines.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("section"), "n_rows") for name, lines in found.items()])
