"""From nested main tables to long rows, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import LIGHT, uv_distance
from ..functions.stokes import complex_difference

LINEAGE = ("corrected_data", "data")


def data_column(main: DataFrame, name: str = "residual") -> Column:
    """A data column by name. residual: corrected less model data, or corrected, or plain data, as far as the columns are there."""
    if name != "residual":
        if name not in main.columns:
            raise ValueError(f"no column {name}")
        return F.col(name)
    if {"corrected_data", "model"} <= set(main.columns):
        return complex_difference(F.col("corrected_data"), F.col("model"))
    return F.col(next(c for c in LINEAGE if c in main.columns))


def pick_field(main: DataFrame, field_id: int | None = None) -> int:
    """The field asked for, or the only one; several without a choice are an error that lists them."""
    if field_id is not None:
        return field_id
    found = [r["field_id"] for r in main.select("field_id").distinct().orderBy("field_id").limit(100).collect()]
    if len(found) != 1:
        raise ValueError(f"choose one of the fields {found}{' and others' if len(found) == 100 else ''}")
    return found[0]


def field_by_name(fields: DataFrame, name: str) -> int:
    row = fields.where(F.col("name") == name).select("field_id").first()
    if row is None:
        raise ValueError(f"no field is named {name}")
    return row["field_id"]


def row_bases(main: DataFrame, descriptions: DataFrame, windows: DataFrame) -> DataFrame:
    """(ddid, nchan, n_rows, base): where each description's rows begin in the flattened numbering."""
    channels = descriptions.join(windows, "spw_id").select("ddid", F.size("chan_freq").alias("nchan"))
    count = F.max("group_rows") if "group_rows" in main.columns else F.count("*")  # stored rows keep their numbers, whichever of them are read
    sizes = main.groupBy("ddid").agg(count.alias("n_rows")).join(channels, "ddid")  # a row per description
    before = F.sum(F.col("n_rows") * F.col("nchan")).over(Window.orderBy("ddid").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("base", F.coalesce(before, F.lit(0)))


def numbered(main: DataFrame) -> DataFrame:
    """``main`` with ``row``, its place among its description's rows in order of row_id. Stored tables have it (``sources.storage``), and nothing moves.
    Of others only (row_id, ddid) are dealt out: rows are counted by range of row_id, the ranges' running sums are added, and within a range there is a window; the numbers then join the rows by row_id."""
    if "row" in main.columns:
        return main
    width = 100_000
    narrow = main.select("row_id", "ddid", F.floor(F.col("row_id") / width).alias("_block"))
    sizes = narrow.groupBy("ddid", "_block").agg(F.count("*").alias("_n"))
    starts = sizes.select("ddid", "_block", (F.sum("_n").over(Window.partitionBy("ddid").orderBy("_block")) - F.col("_n")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("ddid", "_block").orderBy("row_id")) - 1
    numbers = narrow.withColumn("_within", within).join(starts, ["ddid", "_block"]).select("row_id", (F.col("_start") + F.col("_within")).alias("row"))
    return main.join(numbers, "row_id")


#: Channels (of 8 bytes) of all descriptions that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000


def described(main: DataFrame, descriptions: DataFrame, windows: DataFrame) -> DataFrame:
    """(ddid, nchan, n_rows, base, chan_freq), a row per description that has rows; to be broadcast where they have at most ``MAX_BROADCAST`` channels together."""
    own = descriptions.join(windows, "spw_id").select("ddid", "chan_freq")
    dims = row_bases(main, descriptions, windows).join(own, "ddid")
    channels = own.agg(F.sum(F.size("chan_freq") + 1)).first()[0] or 0
    return F.broadcast(dims) if channels <= MAX_BROADCAST else dims


def flatten(main: DataFrame, descriptions: DataFrame, windows: DataFrame, data: str = "residual", flags: bool = True) -> DataFrame:
    """(newrow, ddid, row, chan, u, v, data[corr], flag[corr]) with u and v in wavelengths; one row per row and channel, of all descriptions in one pass."""
    rows = numbered(main.withColumn("_data", data_column(main, data))).join(described(main, descriptions, windows), "ddid")
    cells = F.arrays_zip(F.col("_data").alias("data"), F.col("flag").alias("flag"), F.col("chan_freq").alias("freq"))
    long = rows.select("ddid", "row", "nchan", "base", "u_m", "v_m", F.posexplode(cells).alias("chan", "c"))
    lam = F.lit(LIGHT) / F.col("c.freq")
    kept = ["c.data", "c.flag"] if flags else ["c.data"]
    return long.select((F.col("base") + F.col("row") * F.col("nchan") + F.col("chan")).alias("newrow"), "ddid", "row", "chan", lam.alias("lam"), "u_m", "v_m", (F.col("u_m") / lam).alias("u"), (F.col("v_m") / lam).alias("v"), *kept)


def within_uv(rows: DataFrame, low: float, high: float) -> DataFrame:
    return rows.where(uv_distance(F.col("u"), F.col("v")).between(low, high))


def row_spans(main: DataFrame, descriptions: DataFrame, windows: DataFrame, polarizations: DataFrame) -> DataFrame:
    """A row per field and description: field_id, ddid, n_rows (of the field), n_chan, n_pol (correlations), and the first and last number of the description's rows in the flattened numbering."""
    spans = row_bases(main, descriptions, windows).select("ddid", F.col("nchan").alias("n_chan"), F.col("base").alias("first_row"), (F.col("base") + F.col("n_rows") * F.col("nchan") - 1).alias("last_row"))
    kinds = descriptions.join(polarizations, "polarization_id").select("ddid", F.size("corr_type").alias("n_pol"))
    counts = main.groupBy("field_id", "ddid").agg(F.count("*").alias("n_rows"))
    return counts.join(spans, "ddid").join(kinds, "ddid").select("field_id", "ddid", "n_rows", "n_chan", "n_pol", "first_row", "last_row")


def _merged(flags: Column, hit, size: Column, stokes: str, overwrite: bool) -> Column:
    """The flags of a row's correlations, with those of a Stokes parameter replaced by ``hit``, or joined with it."""
    touched = (F.lit(0), size - 1) if stokes in "IQ" else (F.lit(1), F.lit(2))
    return F.transform(flags, lambda f, i: F.when((i == touched[0]) | (i == touched[1]), hit if overwrite else f | hit).otherwise(f))


def flagged_long(long: DataFrame, flag_ids: DataFrame, stokes: str = "I", overwrite: bool = False) -> DataFrame:
    """``long`` with the flags of a Stokes parameter's correlations set from ``flag_ids(newrow)``: replaced, or joined with what was there. Ids may repeat."""
    ids = flag_ids.select("newrow").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return long.join(ids, "newrow", "left").withColumn("flag", _merged(F.col("flag"), hit, F.size("flag"), stokes, overwrite)).drop("_hit")


def with_hits(rows: DataFrame, hits: DataFrame, stokes: str = "I", overwrite: bool = False) -> DataFrame:
    """Numbered nested rows with the flags of channels ``_hits`` of ``hits(ddid, row, _hits)`` set: replaced, or joined with what was there."""
    new = F.transform("flag", lambda c, k: _merged(c, F.coalesce(F.array_contains("_hits", k), F.lit(False)), F.size(c), stokes, overwrite))
    return rows.join(hits, ["ddid", "row"], "left").withColumn("flag", new).drop("_hits")


def flag_places(flag_ids: DataFrame, main: DataFrame, descriptions: DataFrame, windows: DataFrame) -> DataFrame:
    """(ddid, row, chan) of flag ids. Ids that carry them (``flag_outliers(carry=...)``) are taken as they are; of bare numbers the description is found by range."""
    if {"ddid", "row", "chan"} <= set(flag_ids.columns):
        return flag_ids.select("ddid", "row", F.col("chan").cast("int").alias("chan"))
    dims = described(main, descriptions, windows)
    first, last = F.col("base"), F.col("base") + F.col("n_rows") * F.col("nchan")
    at = F.col("newrow") - F.col("base")
    return flag_ids.select("newrow").join(dims, (F.col("newrow") >= first) & (F.col("newrow") < last)).select("ddid", F.floor(at / F.col("nchan")).alias("row"), (at % F.col("nchan")).cast("int").alias("chan"))


def write_flags(main: DataFrame, descriptions: DataFrame, windows: DataFrame, flag_ids: DataFrame, stokes: str = "I", overwrite: bool = False) -> DataFrame:
    """(row_id, ddid, row, flag): the nested flags (channel x correlation) of ``main`` with those of ``flag_ids(newrow)``, or ``(ddid, row, chan)``, set.

    Ids become rows with a short list of channels (a row has as many as its window at most), and that side joins the nested rows: nothing is exploded or nested again."""
    hits = flag_places(flag_ids, main, descriptions, windows).groupBy("ddid", "row").agg(F.collect_set("chan").alias("_hits"))
    kept = [c for c in ("row_id", "ddid", "row", "flag") if c in main.columns]
    return with_hits(numbered(main.select(*kept)), hits, stokes, overwrite).select("row_id", "ddid", "row", "flag")


def exploded_flags(nested: DataFrame, bases: DataFrame) -> DataFrame:
    """(newrow, flag): a row for each row and channel of nested flags ``(ddid, row, flag)``, numbered as ``flatten`` does. ``bases``: of ``row_bases``, a row per description."""
    long = nested.join(bases.select("ddid", "nchan", "base"), "ddid").select("base", "row", "nchan", F.posexplode("flag").alias("chan", "flag"))
    return long.select((F.col("base") + F.col("row") * F.col("nchan") + F.col("chan")).alias("newrow"), "flag")
