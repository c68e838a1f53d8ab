"""Stored observations: numbers where rows stand, pruning, write-back by partition, storage order."""

import os

import pytest
from pyspark.sql import functions as F

from uvsieve.functions.stokes import stokes_value
from uvsieve.jobs import flag_job
from uvsieve.operators import loading
from uvsieve.sources import fixtures, storage
from uvsieve.sources.observation import DerivedObservation

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def stored(spark, tmp_path):
    return storage.store(DerivedObservation(spark, FOLDER), f"file://{tmp_path}/observation", partitions=5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(o):
    root = o.root.removeprefix("file://")
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def flags_of(o):
    return {r["row_id"]: r["flag"] for r in o.main.select("row_id", "flag").collect()}


def test_stored_rows_and_numbers_are_the_derived_ones(spark, stored):
    derived = DerivedObservation(spark, FOLDER)
    want = loading.flatten(derived.main, derived.descriptions, derived.windows).select("newrow", "ddid", "row", "chan", "u", "v", "flag", stokes_value(F.col("data"), "I"))
    got = loading.flatten(stored.main, stored.descriptions, stored.windows).select(want.columns[:-1] + [stokes_value(F.col("data"), "I")])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_row_moves_to_be_numbered(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(loading.flatten(stored.main, stored.descriptions, stored.windows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "row_id" not in text and not [line for line in text.split("\n") if "Exchange" in line and ("data" in line or "flag" in line)]
    assert "SortMergeJoin" not in text.split("posexplode")[0]


def test_only_the_asked_partitions_are_read(spark, stored):
    read = stored.main.where((F.col("ddid") == 1) & (F.col("field_id") == 2))
    paths = [r[0] for r in read.select("row_id", F.lit(1)).join(spark.read.parquet(f"{stored.root}/run={stored.partitions()[0]['run']}").select("row_id", F.col("_metadata.file_path").alias("p")), "row_id").select("p").distinct().collect()]
    assert paths and all("field_id=2/ddid=1" in p for p in paths)
    text = plan(read)
    line = next(x for x in text.split("\n") if "FileScan parquet" in x and "row_mark" in x)
    assert "PartitionFilters: [" in line and "(ddid" in line.split("PartitionFilters")[1] and "(field_id" in line.split("PartitionFilters")[1]
    assert len(stored.partitions()) == 10


@pytest.mark.parametrize("overwrite", [False, True])
def test_write_back_touches_its_partitions_alone(spark, stored, overwrite):
    old_files, old = files(stored), flags_of(stored)
    ids = stored.main.where("field_id = 1 and row % 3 = 0").select("ddid", "row", F.lit(1).alias("chan"))
    want = {r["row_id"]: r["flag"] for r in loading.write_flags(stored.main.where("field_id = 1"), stored.descriptions, stored.windows, ids.unionAll(ids), "I", overwrite).collect()}
    pairs = stored.write_back(ids.unionAll(ids), "I", overwrite, field_id=1)
    assert pairs == [(1, 0), (1, 1)]
    assert flags_of(stored) == old | want and want != {k: old[k] for k in want}
    assert {k: v for k, v in files(stored).items() if k in old_files} == old_files  # nothing that was there has changed
    assert {tuple(p.split("/")[-3:-1]) for p in set(files(stored)) - set(old_files)} == {("field_id=1", "ddid=0"), ("field_id=1", "ddid=1")}
    stored.write_back(ids, "I", overwrite, field_id=1)  # again: the same
    assert flags_of(stored) == old | want
    stored.tidy()
    assert flags_of(stored) == old | want and len(files(stored)) <= len(old_files) + 10
    assert stored.write_back(ids.limit(0)) == []


def test_a_run_that_dies_leaves_the_old_table(spark, stored, monkeypatch):
    old = flags_of(stored)
    ids = stored.main.select("ddid", "row", F.lit(0).alias("chan"))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(storage.StoredObservation, "_point", die)
        with pytest.raises(KeyboardInterrupt):
            stored.write_back(ids)
    fresh = storage.StoredObservation(spark, stored.folder)
    assert flags_of(fresh) == old
    fresh.write_back(ids)
    assert all(f[0][0] and f[0][3] for f in flags_of(fresh).values())
    fresh.tidy()
    assert len({p.split("run=")[1].split("/")[0] for p in files(fresh)}) == 1


def test_two_writers_do_not_overwrite_each_other(spark, stored):
    with pytest.raises(RuntimeError):
        names = stored._pointers()
        stored._pointers = lambda: names[:-1] + [f"{int(names[-1]) - 1:08d}"]
        stored._point(storage.StoredObservation(spark, stored.folder).partitions())


def test_storage_order(spark, tmp_path):
    main = fixtures.main_table(spark, FOLDER).withColumn("time", F.floor(F.col("time") / 86_400))
    storage.reorder(main.repartition(7), f"file://{tmp_path}/sorted", partitions=6)
    rows = spark.read.parquet(f"file://{tmp_path}/sorted")
    assert tuple(storage.inversions(rows).first()) == (1000, 0)
    assert rows.select(F.shiftright(storage.MARK, storage.PLACE_BITS)).distinct().count() == 6
    got = storage.placed(rows, storage.numbers(rows)).orderBy("row").collect()
    key = [(r["time"], r["antenna1"], r["antenna2"], r["row_id"]) for r in got]
    assert [r["row"] for r in got] == list(range(1000)) and key == sorted(key) and key != sorted(key, key=lambda k: k[3])
    muddled = main.repartition(4).withColumn(storage.MARK, F.monotonically_increasing_id())
    assert storage.inversions(muddled).first()["inversions"] > 100
    with pytest.raises(ValueError):
        storage.marked(main, ("row_id",), 10**6)
    with pytest.raises(ValueError):
        storage.StoredObservation(spark, f"file://{tmp_path}/nothing").partitions()


def test_the_job_writes_flags_into_the_stored_table(spark, stored, tmp_path):
    out, old = f"file://{tmp_path}/out", flags_of(stored)
    flag_job.run(spark, stored, out, field=2, factor=0.1)
    ids = spark.read.parquet(f"{out}/flag_ids")
    own = stored.main.where("field_id = 2")
    want = {r["row_id"]: r["flag"] for r in loading.write_flags(own, stored.descriptions, stored.windows, ids).collect()}
    by_number = {r["row_id"]: r["flag"] for r in loading.write_flags(own, stored.descriptions, stored.windows, ids.select("newrow")).collect()}
    new = flags_of(storage.StoredObservation(spark, stored.folder))
    assert want == by_number and new == old | want and new != old and ids.count() > 0
    derived = DerivedObservation(spark, FOLDER)
    flag_job.run(spark, derived, f"{out}-derived", field=2, factor=0.1)
    beside = {r["row_id"]: r["flag"] for r in spark.read.parquet(f"{out}-derived/flag").collect()}
    assert beside == {k: v for k, v in new.items() if k in beside} and len(beside) == len(want)
