"""Declared schemas of an observation's tables: kinds, units, and which columns may be missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    kind: str
    unit: str = ""
    optional: bool = False


COMPLEX = "array<array<struct<re:float,im:float>>>"
SCHEMAS: dict[str, dict[str, Field]] = {
    "main": {
        "row_id": Field("bigint"), "field_id": Field("int"), "ddid": Field("int"), "scan_number": Field("int", optional=True), "time": Field("double", "s"), "interval": Field("double", "s", True), "state_id": Field("int", optional=True),
        "observation_id": Field("int", optional=True), "array_id": Field("int", optional=True), "antenna1": Field("int", optional=True), "antenna2": Field("int", optional=True), "u_m": Field("double", "m"), "v_m": Field("double", "m"), "flag": Field("array<array<boolean>>"),
    },
    "antenna": {"antenna_id": Field("int"), "name": Field("string"), "station": Field("string", optional=True), "dish_diameter": Field("double", "m"), "offset": Field("array<double>", "m", True), "position": Field("array<double>", "m")},
    "field": {"field_id": Field("int"), "name": Field("string"), "code": Field("string", optional=True), "source_id": Field("int", optional=True), "reference_dir": Field("array<array<double>>", "rad")},
    "spectral_window": {"spw_id": Field("int"), "chan_freq": Field("array<double>", "Hz"), "chan_width": Field("array<double>", "Hz"), "total_bandwidth": Field("double", "Hz"), "name": Field("string", optional=True), "meas_freq_ref": Field("int", optional=True)},
    "data_description": {"ddid": Field("int"), "spw_id": Field("int"), "polarization_id": Field("int")},
    "polarization": {"polarization_id": Field("int"), "corr_type": Field("array<int>")},
    "state": {"state_id": Field("int"), "obs_mode": Field("string")},
    "source": {"source_id": Field("int"), "name": Field("string"), "spw_id": Field("int", optional=True), "rest_frequency": Field("array<double>", "Hz", True), "sysvel": Field("array<double>", "m/s", True)},
    "observation": {"observer": Field("string", optional=True), "project": Field("string", optional=True), "telescope_name": Field("string"), "began": Field("timestamp"), "ended": Field("timestamp")},
}


def conformed(df: DataFrame, name: str, extra: bool = False) -> DataFrame:
    """``df`` with the declared columns of a table, cast to their kinds and with their units as metadata; optional ones that are missing are null. ``extra``: with its other columns too.

    A required column that is missing is an error that names it."""
    declared = SCHEMAS[name]
    here = {c.lower(): c for c in df.columns}
    if missing := [c for c, f in declared.items() if c not in here and not f.optional]:
        raise ValueError(f"table {name} lacks {', '.join(missing)}")
    columns = [(F.col(here[c]) if c in here else F.lit(None)).cast(f.kind).alias(c, metadata={"unit": f.unit}) for c, f in declared.items()]
    return df.select(*columns, *[c for c in df.columns if extra and c.lower() not in declared])


def read_declared(spark: SparkSession, path: str, name: str, extra: bool = False) -> DataFrame:
    """A table whose files may have different columns: names are matched whatever their case, and columns that only some files have are null in the others."""
    return conformed(spark.read.option("mergeSchema", "true").parquet(path), name, extra)


def unit_of(df: DataFrame, column: str) -> str:
    return df.schema[column].metadata.get("unit", "")
