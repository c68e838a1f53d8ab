"""The tables of one observation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from . import fixtures
from .schemas import read_declared


@dataclass(frozen=True)
class Observation:
    """Main table and dimension tables, read when first asked for.

    ``folder`` holds one Parquet table per name (main, antenna, field, spectral_window, data_description, polarization, state,
    source, observation), with the columns that ``schemas`` declares; optional ones may be missing, in some files or in all. The main table's data columns are read as they are."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return read_declared(self.spark, f"{self.folder}/{name}.parquet", name, extra=name == "main")

    @cached_property
    def main(self) -> DataFrame:
        return self.table("main")

    @cached_property
    def descriptions(self) -> DataFrame:
        return self.table("data_description")

    @cached_property
    def windows(self) -> DataFrame:
        return self.table("spectral_window")

    @cached_property
    def polarizations(self) -> DataFrame:
        return self.table("polarization")

    @cached_property
    def states(self) -> DataFrame:
        return self.table("state")

    @cached_property
    def antennas(self) -> DataFrame:
        return self.table("antenna")

    @cached_property
    def sources(self) -> DataFrame:
        return self.table("source")

    @cached_property
    def observations(self) -> DataFrame:
        return self.table("observation")

    @cached_property
    def fields(self) -> DataFrame:
        return self.table("field")


class DerivedObservation(Observation):
    """An observation derived from a folder of general tables (events, supplier, region)."""

    def table(self, name: str) -> DataFrame:
        with_folder = {"main": fixtures.main_table, "antenna": fixtures.antennas, "field": fixtures.fields, "source": fixtures.sources, "observation": fixtures.observations}
        plain = {"data_description": fixtures.data_descriptions, "spectral_window": fixtures.spectral_windows, "polarization": fixtures.polarizations, "state": fixtures.states}
        return with_folder[name](self.spark, self.folder) if name in with_folder else plain[name](self.spark)
