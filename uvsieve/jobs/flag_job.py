"""spark-submit entry: flag an observation's interference and write flags and grids.

    spark-submit flag_job.py OBSERVATION OUT --field 0 --sigma 3 --stokes I --uvrange 0 1500
    spark-submit flag_job.py OBSERVATION OUT --store 2000    (writes the observation to OUT, so that flags can be written back into it)
    spark-submit flag_job.py STORED OUT --field 0 --stored   (flags go back into STORED itself)
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from uvsieve.functions.geometry import observation_limits, physical_grid
from uvsieve.functions.stokes import stokes_flag, stokes_value
from uvsieve.operators import loading
from uvsieve.operators.flags import flag_outliers
from uvsieve.sources.observation import Observation
from uvsieve.sources.storage import StoredObservation, store


def run(spark: SparkSession, observation: Observation, out: str, *, field: int | None = None, column: str = "residual", stokes: str = "I", component: str = "real", sigma: float = 3.0, uvrange: tuple[float, float] | None = None, factor: float = 1.0, overwrite: bool = False) -> None:
    """Writes OUT/flag_ids, OUT/median_before and OUT/median_after. Flags go back into a stored observation's own table; of another, OUT/flag has them, nested as in the main table."""
    chosen = loading.pick_field(observation.main, field)
    main = observation.main.where(F.col("field_id") == chosen)
    long = loading.flatten(main, observation.descriptions, observation.windows, column)
    places = ("ddid", "row", "chan")
    rows = long.select("newrow", *places, "u_m", "v_m", "lam", "u", "v", stokes_value(F.col("data"), stokes, component).alias("value"), stokes_flag(F.col("flag"), stokes).alias("flag"))
    diameter = observation.antennas.agg(F.avg("dish_diameter")).first()[0]
    grid = physical_grid(observation_limits(main, observation.windows), diameter=diameter, factor=factor)  # before rows are chosen: bins don't move with the choice
    rows = loading.within_uv(rows, *uvrange) if uvrange else rows
    found = flag_outliers(rows, grid, sigma=sigma, carry=places)
    found.flagged_rows().write.mode("overwrite").parquet(f"{out}/flag_ids")
    found.cells.select("u_bin", "v_bin", "n", "median").write.mode("overwrite").parquet(f"{out}/median_before")
    found.median_after().write.mode("overwrite").parquet(f"{out}/median_after")
    ids = spark.read.parquet(f"{out}/flag_ids")
    if isinstance(observation, StoredObservation):
        observation.write_back(ids, stokes, overwrite, field_id=chosen)
    else:
        loading.write_flags(main, observation.descriptions, observation.windows, ids, stokes, overwrite).write.mode("overwrite").parquet(f"{out}/flag")
    logging.getLogger(__name__).info("flagged %s rows", ids.count())


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("observation"), p.add_argument("out")
    p.add_argument("--field", type=int), p.add_argument("--column", default="residual"), p.add_argument("--stokes", default="I"), p.add_argument("--component", default="real")
    p.add_argument("--sigma", type=float, default=3.0), p.add_argument("--uvrange", type=float, nargs=2), p.add_argument("--factor", type=float, default=1.0), p.add_argument("--overwrite", action="store_true")
    p.add_argument("--stored", action="store_true"), p.add_argument("--store", type=int, metavar="PARTITIONS")
    a = p.parse_args()
    spark = SparkSession.builder.appName("flag").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.store:
        store(Observation(spark, a.observation), a.out, a.store)
        return
    run(spark, (StoredObservation if a.stored else Observation)(spark, a.observation), a.out, field=a.field, column=a.column, stokes=a.stokes, component=a.component, sigma=a.sigma, uvrange=tuple(a.uvrange) if a.uvrange else None, factor=a.factor, overwrite=a.overwrite)
    spark.stop()


if __name__ == "__main__":
    main()
