"""Main tables as stored: in storage order, partitioned by field and description, numbered where they stand, and flags written back into them.

A row's mark is its partition's number and its place there, given while the rows are sorted by range; it is stored with the row. How many rows
came before each partition is a table as short as there were partitions (a parameter), so numbers are arithmetic on marks: no row is moved to be numbered.

A stored table is a set of partition folders named by a pointer file. A write-back stages new folders for the partitions that it touches and then writes the next pointer, in one rename:
a run that is killed before has changed nothing, other partitions' files are never touched, and running again gives the same.
"""

from __future__ import annotations

import json
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.loading import with_hits
from .observation import Observation

MARK = "row_mark"
#: A mark's low bits are the place within a partition (as ``monotonically_increasing_id`` deals them).
PLACE_BITS = 33
#: Partitions that rows may be sorted into: bounds the table of numbers, and so what is broadcast.
MAX_PARTITIONS = 50_000
STORAGE_ORDER = ("time", "antenna1", "antenna2")


def marked(main: DataFrame, keys: tuple[str, ...], partitions: int | None = None) -> DataFrame:
    """``main`` sorted over the cluster by ``keys``, with each row's mark. The keys must tell rows apart, or rows of equal keys be alike."""
    n = partitions or int(main.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not 0 < n <= MAX_PARTITIONS:
        raise ValueError(f"1 to {MAX_PARTITIONS} partitions, not {n}")
    return main.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(MARK, F.monotonically_increasing_id())


def numbers(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, part, first, before, whole) of marked rows: each partition's first mark, how many rows came before it and how many there are in all, within each group of ``by``.
    Groups are sorted runs, so there are no more rows than partitions and groups together."""
    found = rows.groupBy(*by, F.shiftright(MARK, PLACE_BITS).alias("part")).agg(F.min(MARK).alias("first"), F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("part")
    whole = Window.partitionBy(*by)
    return found.select(*by, "part", "first", (F.sum("_n").over(upto) - F.col("_n")).alias("before"), F.sum("_n").over(whole).alias("whole"))


def placed(rows: DataFrame, table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Marked rows with ``row``, their place (from 0) within their group, and ``group_rows``, the group's rows. ``table``: their ``numbers``, which are broadcast: no longer than ``MAX_PARTITIONS`` and the groups."""
    keyed = rows.withColumn("part", F.shiftright(MARK, PLACE_BITS))
    return keyed.join(F.broadcast(table), [*by, "part"]).withColumn("row", F.col("before") + F.col(MARK) - F.col("first")).withColumnRenamed("whole", "group_rows").drop("part", "first", "before")


def reorder(main: DataFrame, path: str, keys: tuple[str, ...] = STORAGE_ORDER, partitions: int | None = None) -> None:
    """Writes ``main`` to ``path`` in storage order: each file sorted, and files in order of their marks. Beyond ``keys``, row_id tells rows apart."""
    marked(main, (*keys, "row_id"), partitions).write.parquet(path)


def inversions(stored: DataFrame, keys: tuple[str, ...] = STORAGE_ORDER) -> DataFrame:
    """(n_rows, inversions): how many rows of a reordered table there are, and how many come before their predecessor in order of the keys, within and across its partitions."""
    key = F.struct(*keys)
    rows = stored.select(F.shiftright(MARK, PLACE_BITS).alias("part"), MARK, key.alias("key"))
    within = Window.partitionBy("part").orderBy(MARK)
    inside = rows.withColumn("_last", F.lag("key").over(within)).groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("key") < F.col("_last")).alias("bad"), F.min_by("key", MARK).alias("head"), F.max_by("key", MARK).alias("tail"))
    across = inside.withColumn("_before", F.lag("tail").over(Window.orderBy("part")))  # a row per partition
    return across.agg(F.sum("n").alias("n_rows"), (F.sum("bad") + F.count_if(F.col("head") < F.col("_before"))).alias("inversions"))


class StoredObservation(Observation):
    """An observation whose main table was written by ``store``. Its rows have their numbers: ``row`` within their description, in order of row_id, and ``group_rows``."""

    @property
    def root(self) -> str:
        return f"{self.folder}/main"

    @cached_property
    def main(self) -> DataFrame:
        folders = [f"{self.root}/run={p['run']}/field_id={p['field_id']}/ddid={p['ddid']}" for p in self.partitions()]
        rows = self.spark.read.option("basePath", self.root).parquet(*folders).drop("run")
        return placed(rows, self.spark.read.parquet(f"{self.folder}/numbers"), ("ddid",))

    def _pointers(self) -> list[str]:
        fs, path = _file_system(self.spark, f"{self.root}/_current")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def partitions(self) -> list[dict]:
        """The partitions that make up the table now: field_id, ddid and the run that wrote them."""
        names = [n for n in self._pointers() if not n.startswith(".")]
        if not names:
            raise ValueError(f"no observation was stored in {self.folder}")
        return [json.loads(r[0]) for r in self.spark.read.text(f"{self.root}/_current/{names[-1]}").collect()]

    def _point(self, partitions: list[dict]) -> None:
        """Makes ``partitions`` the table, in one rename; another writer's pointer of the same number is an error."""
        names = [n for n in self._pointers() if not n.startswith(".")]
        number = int(names[-1]) + 1 if names else 1
        fs, staged = _file_system(self.spark, f"{self.root}/_current/.{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(bytearray("\n".join(json.dumps(p, sort_keys=True) for p in partitions).encode()))
        out.close()
        _, final = _file_system(self.spark, f"{self.root}/_current/{number:08d}")
        if fs.exists(final) or not fs.rename(staged, final):
            raise RuntimeError("another run wrote to this table meanwhile")
        self.__dict__.pop("main", None)

    def _stage(self, rows: DataFrame) -> str:
        """Writes rows with their marks as a run of their own; nothing reads it until it is pointed at."""
        run = uuid.uuid4().hex
        rows.sortWithinPartitions("field_id", "ddid", MARK).write.partitionBy("field_id", "ddid").parquet(f"{self.root}/run={run}")
        return run

    def write_back(self, flag_ids: DataFrame, stokes: str = "I", overwrite: bool = False, field_id: int | None = None) -> list[tuple[int, int]]:
        """Sets the flags of ``flag_ids(ddid, row, chan)`` in the stored table, and gives the (field_id, ddid) of partitions written. Flags are joined with what is there, or replace
        it (``overwrite``: then every partition of the field, or of all fields, is written). Ids may repeat."""
        main = self.main if field_id is None else self.main.where(F.col("field_id") == field_id)
        hits = flag_ids.groupBy("ddid", "row").agg(F.collect_set("chan").alias("_hits"))
        touched = main if overwrite else main.select("field_id", "ddid", "row").join(hits.select("ddid", "row"), ["ddid", "row"], "left_semi")
        pairs = sorted((r["field_id"], r["ddid"]) for r in touched.select("field_id", "ddid").distinct().collect())  # as many as the table has partitions
        if not pairs:
            return []
        here = F.lit(False)
        for f, d in pairs:
            here = here | ((F.col("field_id") == f) & (F.col("ddid") == d))
        run = self._stage(with_hits(main.where(here), hits, stokes, overwrite).drop("row", "group_rows"))
        written = {(f, d): run for f, d in pairs}
        self._point([p | {"run": written.get((p["field_id"], p["ddid"]), p["run"])} for p in self.partitions()])
        return pairs

    def tidy(self) -> None:
        """Deletes runs, and partitions of runs, that the table no longer consists of. Not while others read or write it."""
        kept: dict[str, set[tuple[str, str]]] = {}
        for p in self.partitions():
            kept.setdefault(f"run={p['run']}", set()).add((f"field_id={p['field_id']}", f"ddid={p['ddid']}"))
        fs, root = _file_system(self.spark, self.root)
        for run in (s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("run=")):
            if run.getName() not in kept:
                fs.delete(run, True)
                continue
            for field in (s.getPath() for s in fs.listStatus(run) if s.isDirectory()):
                for part in (s.getPath() for s in fs.listStatus(field) if s.isDirectory()):
                    if (field.getName(), part.getName()) not in kept[run.getName()]:
                        fs.delete(part, True)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def store(observation: Observation, folder: str, partitions: int | None = None) -> StoredObservation:
    """Writes all tables of an observation to ``folder``: the main table partitioned by field and description, its rows numbered within each description in order of row_id; the others as they are."""
    stored = StoredObservation(observation.spark, folder)
    for name in ("antenna", "field", "source", "observation", "data_description", "spectral_window", "polarization", "state"):
        observation.table(name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    run = stored._stage(marked(observation.main, ("ddid", "row_id"), partitions))
    rows = observation.spark.read.parquet(f"{stored.root}/run={run}")
    numbers(rows, ("ddid",)).write.mode("overwrite").parquet(f"{folder}/numbers")
    pairs = sorted((r["field_id"], r["ddid"]) for r in rows.select("field_id", "ddid").distinct().collect())  # as many as the table has partitions
    stored._point([{"field_id": f, "ddid": d, "run": run} for f, d in pairs])
    return stored
