"""Observation tables derived from the general tables ``events``, ``supplier`` and ``region``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import MJD_UNIX
from ..functions.geometry import LIGHT

DIAMETER = 13.5
#: Frequencies of each spectral window's channels in Hz, and the window of each data description.
WINDOWS = {0: [1.0e9, 1.1e9, 1.2e9, 1.3e9], 1: [1.4e9, 1.5e9]}
DESCRIPTIONS = {0: 1, 1: 0}


def _amplitude(value: str) -> F.Column:
    """Rayleigh-like amplitudes with interference of four kinds and some zeros, by integer arithmetic on event_id."""
    e, root = F.col("event_id"), F.sqrt(F.col(value))
    return (
        F.when(e % 41 == 0, F.lit(0.0))
        .when((F.col("event_type") == "error") & (F.col("chan") == 1) & (e % 31).isin(3, 4, 5), 6 * root)
        .when((e % 31).isin(20, 21) & ((e * 7) % 29).isin(10, 11), 20 * root)
        .when(e % 701 == 0, 300 * root)
        .otherwise(root)
    )


def _placed(events: DataFrame) -> DataFrame:
    e, user = F.col("event_id"), F.col("user_id")
    return events.withColumn("u_m", ((e % 31) - 15) * F.lit(30.0) + (user % 15) * 2).withColumn("v_m", (((e * 7) % 29) - 14) * F.lit(30.0) + (user % 13) * 2)


def visibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table: newrow, event_id, user_id, chan, lam, u_m, v_m, u, v, amp, flag; four channels an event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    rows = _placed(events).withColumn("chan", F.explode(F.sequence(F.lit(0), F.lit(3))))
    lam = F.lit(LIGHT) / (F.lit(1.0e9) + F.lit(1.0e8) * F.col("chan"))
    return rows.select(
        (F.col("event_id") * 4 + F.col("chan")).alias("newrow"), "event_id", "user_id", "chan", lam.alias("lam"), "u_m", "v_m",
        (F.col("u_m") / lam).alias("u"), (F.col("v_m") / lam).alias("v"), _amplitude("value").alias("amp"), (F.col("event_id") % 23 == 0).alias("flag"),
    )


def main_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested main table: a row per event, channel x correlation arrays of data and flags."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    e = F.col("event_id")
    description = (e % 2).cast("int")
    channels = F.when(description == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.sequence(F.lit(0), F.lit(3)))
    base = _placed(events).withColumn("root", F.sqrt("value"))
    narrow = (F.col("event_type") == "error") & (e % 31).isin(3, 4, 5)
    wide = (e % 31).isin(20, 21) & ((e * 7) % 29).isin(10, 11)

    def amp(chan):
        root = F.col("root")
        return F.when(e % 41 == 0, F.lit(0.0)).when(narrow & (chan == 1), 6 * root).when(wide, 20 * root).when(e % 701 == 0, 300 * root).otherwise(root)

    def cell(re, im):
        return F.struct(re.cast("float").alias("re"), im.cast("float").alias("im"))

    def correlations(chan, times: int = 1):
        a = amp(chan) * times
        return F.array(cell(a / 2, a / 4), cell(a / 8, a / 4), cell(a / 16, a / 4), cell(a / 2, a / 4))

    flags = F.array(e % 23 == 0, F.lit(False), e % 29 == 0, e % 37 == 0)
    kinds = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    state = F.when(e % 17 == 0, F.lit(-1)).otherwise(F.array_position(kinds, F.col("event_type")).cast("int") - 1)
    return base.select(
        e.alias("row_id"), (F.col("user_id") % 5).cast("int").alias("field_id"), description.alias("ddid"), F.dayofmonth("ts").alias("scan_number"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1.0e6) + F.lit(float(MJD_UNIX * 86_400))).alias("time"), F.lit(8.0).alias("interval"), state.alias("state_id"),
        F.lit(0).alias("observation_id"), F.lit(0).alias("array_id"), (F.col("user_id") % 4).cast("int").alias("antenna1"), (F.col("user_id") % 4 + 1 + e % 5).cast("int").alias("antenna2"), "u_m", "v_m",
        F.transform(channels, lambda c: correlations(c)).alias("data"), F.transform(channels, lambda c: correlations(c, 2)).alias("corrected_data"),
        F.transform(channels, lambda c: correlations(c)).alias("model"), F.transform(channels, lambda c: flags).alias("flag"),
    )


def spectral_windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, f, [1.0e8] * len(f), 1.0e8 * len(f), f"SPW{k}", 5) for k, f in WINDOWS.items()], "spw_id int, chan_freq array<double>, chan_width array<double>, total_bandwidth double, name string, meas_freq_ref int")


def data_descriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, s, 0) for d, s in DESCRIPTIONS.items()], "ddid int, spw_id int, polarization_id int")


def polarizations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, [9, 10, 11, 12])], "polarization_id int, corr_type array<int>")


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(("click", "error", "purchase", "signup", "view"))), "state_id int, obs_mode string")


def antennas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal")
    k = F.col("s_suppkey")
    position = F.array((F.lit(5_109_000.0) + (k * 37) % 4_001), (F.lit(2_006_000.0) + (k * 53) % 3_001), (F.lit(-3_239_000.0) + F.floor("s_acctbal")))
    return s.select(k.cast("int").alias("antenna_id"), F.col("s_name").alias("name"), F.concat(F.lit("P"), k.cast("string")).alias("station"), F.lit(DIAMETER).alias("dish_diameter"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("offset"), position.alias("position"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")
    k = F.col("r_regionkey").cast("double")
    return r.select(F.col("r_regionkey").cast("int").alias("field_id"), F.col("r_name").alias("name"), F.lit("T").alias("code"), F.col("r_regionkey").cast("int").alias("source_id"), F.array(F.array(k * 0.1, k * 0.2 - 0.5)).alias("reference_dir"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source per field; every other one has a line with a rest frequency, and every third a velocity."""
    k = F.col("r_regionkey").cast("int")
    none = F.array().cast("array<double>")
    return spark.read.parquet(f"{sf_dir}/region.parquet").select(
        k.alias("source_id"), F.col("r_name").alias("name"), (k % 2).alias("spw_id"),
        F.when(k % 2 == 0, F.array(F.lit(1.42e9) + k * 1e6)).otherwise(none).alias("rest_frequency"), F.when(k % 3 == 0, F.array(k * F.lit(1000.0))).alias("sysvel"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation, as long as the events last."""
    span = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"))
    return span.select(F.lit("observer").alias("observer"), F.lit("project").alias("project"), F.lit("array").alias("telescope_name"), "began", "ended")


def bad_ranges(spark: SparkSession) -> DataFrame:
    """Frequency ranges of known interference."""
    return spark.createDataFrame([("850~985MHz",), ("1090~1250MHz",), ("1490~1580MHz",)], "range string")
