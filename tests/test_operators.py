"""Operators against NumPy and by their invariants, on small made inputs."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from uvsieve.functions import formats, geometry, thresholds
from uvsieve.functions.stokes import stokes_flag, stokes_value
from uvsieve.operators import annuli, baselines, cells, flags, loading, profiles, summary
from uvsieve.sources import fixtures
from uvsieve.sources.observation import DerivedObservation, Observation

FOLDER = "/root/testdata/sf0.001"


def column(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


@pytest.mark.parametrize("low,high,n", [(-1.0, 2.0, 7), (0.1, 0.9, 73), (-3.7, 11.3, 2), (5.0, 5.5, 40)])
def test_bins_are_numpys(spark, low, high, n):
    axis = geometry.Axis(low, high, n)
    edges = np.array(axis.edges)
    assert np.allclose(edges, np.linspace(low, high, n))
    values = [*edges, *np.nextafter(edges, -9e9), *np.nextafter(edges, 9e9), *np.random.default_rng(1).uniform(low - 1, high + 1, 500)]
    got = [r[0] for r in column(spark, values).select(axis.bin(F.col("x"))).collect()]
    assert got == np.digitize(values, edges).tolist()


def test_bin_zero_wraps_to_last_edge(spark):
    axis = geometry.Axis(1.0, 4.0, 4)
    got = [r[0] for r in spark.createDataFrame([(0,), (1,), (4,)], "b int").select(axis.edge_of(F.col("b"))).collect()]
    assert got == [4.0, 1.0, 4.0]


def test_statistical_grid(spark):
    rows = fixtures.visibilities(spark, FOLDER)
    grid = geometry.plan_grid(rows, diameter=13.5, factor=1.0, method="statistical")
    assert grid.u.count > 1 and grid.v.count > 1
    with pytest.raises(ValueError):
        geometry.plan_grid(rows, diameter=13.5, method="other")


@pytest.mark.parametrize("hot", [3, 10**9])
def test_medians(spark, hot):
    draw = random.Random(4)
    rows = [(k % 3, k % 2, k, draw.choice([draw.random(), 0.5, 1.0])) for k in range(301)] + [(9, 9, 999, 4.0), (8, 8, 1000, 1.0), (8, 8, 1001, 2.0)]
    df = spark.createDataFrame(rows, "u_bin int, v_bin int, newrow long, value double")
    got = {(r[0], r[1]): r[2] for r in cells.medians(df, hot=hot).collect()}
    want = {k: float(np.median([r[3] for r in rows if (r[0], r[1]) == k])) for k in {(r[0], r[1]) for r in rows}}
    assert got == want


def clipped(x, k):
    x = np.array(x)
    while len(x) >= 2:
        c, s = x.mean(), x.std(ddof=1)
        kept = x[(x > c - k * s) & (x < c + k * s)]
        if len(kept) == len(x):
            break
        x = kept
    return sorted(x.tolist())


def test_sigma_clips_agree(spark):
    rng = np.random.default_rng(2)
    groups = {k: np.r_[rng.rayleigh(1, 50), rng.rayleigh(9, k)].tolist() for k in range(12)} | {20: [1.0], 21: [2.0, 2.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, v in groups.items()], "g int, x array<double>")
    by_array = {r[0]: sorted(r[1]) for r in df.select("g", thresholds.sigma_clip(F.col("x"), 3, 3)).collect()}
    rows = df.select("g", F.explode("x").alias("value"))
    bounds = flags.clip_groups(rows, 3, keys=["g"])
    kept = rows.join(bounds, "g").where((F.col("value") > F.col("low")) & (F.col("value") < F.col("high"))).groupBy("g").agg(F.array_sort(F.collect_list("value")))
    by_rows = {r[0]: r[1] for r in kept.collect()}
    for k, v in groups.items():
        want = clipped(v, 3)
        if k != 21:  # equal values: no spread, so nothing lies strictly inside
            assert by_array[k] == pytest.approx(want)
            assert by_rows[k] == pytest.approx(want)
    assert by_array[21] == [] and 21 not in by_rows


def one_cell(spark, values, upper):
    rows = spark.createDataFrame([(1, 1, k, float(v)) for k, v in enumerate(values)], "u_bin int, v_bin int, newrow long, value double")
    known = cells.cell_stats(rows).withColumn("annulus_id", F.lit(0))
    return flags.cell_thresholds(rows, known, annuli.Annuli((9.0,), (0.0,), (upper,))).first()


def test_threshold_branches(spark):
    good = np.random.default_rng(3).rayleigh(1, 400)
    assert one_cell(spark, good, 9.0)["branch"] == "trusted"
    r = one_cell(spark, good, 9.0)
    s, a = np.median(good) / math.sqrt(2 * math.log(2)), 1 / 800
    assert r["lo"] == pytest.approx(s * math.sqrt(-2 * math.log(1 - a / 2))) and r["hi"] == pytest.approx(s * math.sqrt(-2 * math.log(a / 2)))
    assert one_cell(spark, [*good, *[60.0] * 30], 1.5)["branch"] == "recovered"
    assert one_cell(spark, good + 50, 1.0)["branch"] == "empty"
    assert one_cell(spark, good * 0.1 + 2.5, 1.0)["branch"] == "dropped"
    assert one_cell(spark, good, None)["branch"] == "trusted"


def test_flagging_parts_are_disjoint_and_whole(spark):
    rows = fixtures.visibilities(spark, FOLDER).withColumn("value", F.col("amp"))
    run = flags.flag_outliers(rows, geometry.plan_grid(rows, diameter=13.5, factor=0.1))
    hit = [r[0] for r in run.flagged_rows().collect()]
    assert len(hit) == len(set(hit))
    kept = [r[0] for r in run.judged().where("not outlier").select("newrow").collect()]
    before = [r[0] for r in rows.where("flag").select("newrow").collect()]
    assert sorted(hit + kept + before) == sorted(r[0] for r in rows.select("newrow").collect())
    again = flags.flag_outliers(rows.repartition(3), geometry.plan_grid(rows, diameter=13.5, factor=0.1), hot=50)
    assert sorted(hit) == sorted(r[0] for r in again.flagged_rows().collect())


def test_empty_rows_are_refused(spark):
    with pytest.raises(ValueError):
        geometry.plan_grid(fixtures.visibilities(spark, FOLDER).limit(0), diameter=13.5)


def test_stokes(spark):
    df = spark.createDataFrame([([(1.0, 2.0), (3.0, 4.0), (5.0, 6.0), (7.0, 8.0)], [True, False, False, False])], "d array<struct<re:float,im:float>>, f array<boolean>")
    got = df.select(*[stokes_value(F.col("d"), s) for s in "IQUV"], stokes_value(F.col("d"), "I", "abs"), stokes_flag(F.col("f"), "I"), stokes_flag(F.col("f"), "U"), stokes_flag(F.col("f"), "A")).first()
    assert tuple(got) == (8.0, -6.0, 8.0, -2.0, math.sqrt(64 + 100), True, False, True)
    with pytest.raises(ValueError):
        stokes_value(F.col("d"), "X")


@pytest.mark.parametrize("stokes,overwrite", [("I", False), ("I", True), ("U", False), ("V", True)])
def test_write_back_by_rows_and_by_long_rows_agree(spark, stokes, overwrite):
    o = DerivedObservation(spark, FOLDER)
    long = loading.flatten(o.main, o.descriptions, o.windows)
    some = long.where("newrow % 7 = 0").select("newrow")
    ids = some.union(some).union(long.where("newrow = 11").select("newrow"))  # ids may repeat
    flat = {(r["ddid"], r["row"], r["chan"]): r["flag"] for r in loading.flagged_long(long, ids, stokes, overwrite).collect()}
    nested = loading.write_flags(o.main, o.descriptions, o.windows, ids, stokes, overwrite).collect()
    assert len(nested) == o.main.count()
    assert {(r["ddid"], r["row"], k): f for r in nested for k, f in enumerate(r["flag"])} == flat
    untouched = {r["row_id"]: r["flag"] for r in loading.write_flags(o.main, o.descriptions, o.windows, some.limit(0)).collect()}
    assert untouched == {r["row_id"]: r["flag"] for r in o.main.select("row_id", "flag").collect()}


def test_flattened_numbers_are_dense_and_data_stays_put(spark):
    o = DerivedObservation(spark, FOLDER)
    long = loading.flatten(o.main, o.descriptions, o.windows)
    got = sorted(r[0] for r in long.select("newrow").collect())
    assert got == list(range(len(got)))
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ddid" in plan  # the narrow numbers
    assert not [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "data" in line]


def test_tables_from_parquet_with_and_without_optional_columns(spark, tmp_path):
    o = DerivedObservation(spark, FOLDER)
    for name in ("main", "antenna", "field", "spectral_window", "data_description", "polarization", "state", "source", "observation"):
        o.table(name).write.parquet(str(tmp_path / f"{name}.parquet"))
    read = Observation(spark, str(tmp_path))
    assert summary.section_sizes(read).collect() == summary.section_sizes(o).collect()
    assert read.observations.count() == 1
    full = {r["source_id"]: (r["rest_frequency"], r["system_velocity"]) for r in summary.source_list(read.sources).collect()}
    assert full == {k: (1.42e9 + k * 1e6 if k % 2 == 0 else 0.0, k * 1000.0 if k % 3 == 0 else 0.0) for k in full} and len(full) == 5
    bare = summary.source_list(read.sources.drop("rest_frequency", "sysvel")).collect()
    assert {(r["rest_frequency"], r["system_velocity"]) for r in bare} == {(0.0, 0.0)}
    same = lambda x: sorted(map(tuple, loading.flatten(x.main, x.descriptions, x.windows).select("newrow", "u", "flag").collect()))
    assert same(read) == same(o)


@pytest.mark.parametrize("shape", ["ball", "rod", "same", "one", "none"])
def test_longest_baseline_brute_force(spark, shape):
    rng = random.Random(shape)
    n, z = {"one": 1, "none": 0}.get(shape, 150), 0.0 if shape == "same" else 1.0
    at = [[z * rng.gauss(0, 1), z * rng.gauss(0, 1), z * rng.gauss(0, 30 if shape == "rod" else 1)] for _ in range(n)]
    got = summary.longest_baseline(spark.createDataFrame(list(enumerate(at)), "antenna_id int, position array<double>")).first()[0]
    assert got == (pytest.approx(max(math.dist(a, b) for a in at for b in at), abs=1e-12) if n > 1 else None)


def test_a_sample_of_cells_is_of_cells(spark):
    grid = spark.range(2000).selectExpr("cast(id % 40 as int) AS u_bin", "cast(id / 40 as int) AS v_bin", "rand(3) AS median")
    whole = {tuple(r) for r in grid.collect()}
    some = [tuple(r) for r in profiles.sample_rows(grid, 0.2, 7).collect()]
    assert set(some) <= whole and 300 < len(some) < 500  # drawn with replacement
    assert some == [tuple(r) for r in profiles.sample_rows(grid, 0.2, 7).collect()]


@pytest.mark.parametrize("hot", [10**6, 20])
def test_summary_and_spreads_brute_force(spark, hot):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.randrange(2), k, rng.choice([1.0, 2.5, rng.random() * 9])) for k in range(600)]
    df = spark.createDataFrame(rows, "u_bin int, v_bin int, newrow long, value double")
    groups = {}
    for u, v, _, x in rows:
        groups.setdefault((u, v), []).append(x)
    for r in cells.summary(df, hot=hot).collect():
        x = groups[r["u_bin"], r["v_bin"]]
        m = statistics.median(x)
        assert (r["n"], r["median"]) == (len(x), pytest.approx(m))
        assert (r["std"], r["mad"], r["ratio"]) == (pytest.approx(statistics.pstdev(x)), pytest.approx(1.4826 * statistics.median(abs(y - m) for y in x)), pytest.approx(statistics.mean(x) / m))
    norm = {(r["u_bin"], r["v_bin"]): r["rms"] for r in cells.rms_grid(df, normalised=True, hot=hot).collect()}
    assert norm == {k: pytest.approx(math.sqrt(statistics.mean((y - statistics.median(x)) ** 2 for y in x))) for k, x in groups.items()}


def test_field_choice(spark):
    main = fixtures.main_table(spark, FOLDER)
    with pytest.raises(ValueError):
        loading.pick_field(main)
    assert loading.pick_field(main.where("field_id = 3")) == 3 and loading.pick_field(main, 1) == 1
    with pytest.raises(ValueError):
        loading.field_by_name(fixtures.fields(spark, FOLDER), "nowhere")


def test_formats(spark):
    df = spark.createDataFrame([(-0.5,), (12.75,), (-0.00000001,)], "d double")
    assert [r[0] for r in df.select(formats.degrees_minutes_seconds(F.col("d"))).collect()] == ["-0.30.00.00", "12.45.00.00", "0.00.00.00"]
    assert df.select(formats.hours_minutes_seconds(F.radians(F.lit(15.0)))).first()[0] == "1:00:00.00"
    assert df.select(formats.correlation_names(F.array(F.lit(9), F.lit(12), F.lit(5)))).first()[0] == "XX,YY,RR"


def test_observation_summary(spark):
    lists = summary.observation_summary(DerivedObservation(spark, FOLDER))
    assert {k: v.count() > 0 for k, v in lists.items()} == dict.fromkeys(("main", "scans", "fields", "intents", "sources", "windows", "antennas"), True)


def test_geodetic(spark):
    x = spark.range(1).select(*summary.geodetic(F.lit(6378137.0), F.lit(0.0), F.lit(0.0)), *summary.geodetic(F.lit(0.0), F.lit(1e-3), F.lit(6356752.314245))).first()
    assert x[0:3] == pytest.approx((0, 0, 0), abs=1e-6) and x[4] == pytest.approx(90, abs=1e-6) and x[5] == pytest.approx(0, abs=1e-3)


def test_fixed_thresholds_refuse():
    with pytest.raises(ValueError):
        thresholds.fixed_alpha(6)
    with pytest.raises(ValueError):
        thresholds.checked_alpha(1.5)


def test_job_writes(spark, tmp_path):
    from uvsieve.jobs import flag_job

    flag_job.run(spark, DerivedObservation(spark, FOLDER), str(tmp_path), field=2, factor=0.1, uvrange=(0, 5000))
    assert spark.read.parquet(f"{tmp_path}/flag_ids").count() > 0
    assert spark.read.parquet(f"{tmp_path}/flag").columns == ["row_id", "ddid", "row", "flag"]


def test_stream_counts(spark, tmp_path):
    from uvsieve.streaming.occupancy import cell_counts

    rows = fixtures.visibilities(spark, FOLDER).select("u", "v", "flag", F.timestamp_seconds(F.col("newrow")).alias("time"))
    rows.write.parquet(str(tmp_path / "in"))
    grid = geometry.Grid(geometry.Axis(-3000, 3000, 5), geometry.Axis(-3000, 3000, 5))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = cell_counts(stream, grid).writeStream.format("memory").queryName("occupancy").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from occupancy").first()[0] == rows.count()


def test_projections_by_every_pair(spark):
    o = DerivedObservation(spark, FOLDER)
    got = {r["moment"]: r["wavelengths"] for r in baselines.longest_projections(o, 3).collect()}
    points = [r["position"] for r in o.antennas.collect()]
    ra, dec = o.fields.where("field_id = 3").first()["reference_dir"][0]
    times = o.main.agg(F.min("time"), F.max("time")).first()
    lon = math.atan2(*(np.mean([p[k] for p in points]) for k in (1, 0)))
    for name, t in (("begin", times[0]), ("middle", sum(times) / 2), ("end", times[1])):
        h = baselines.sidereal_angle(t, lon) - ra
        turn = np.array([[math.sin(h), math.cos(h), 0], [-math.sin(dec) * math.cos(h), math.sin(dec) * math.sin(h), math.cos(dec)]])
        uv = [turn @ np.array(p) for p in points]
        assert got[name] == pytest.approx(max(np.hypot(*(a - b)) for a in uv for b in uv) * 1.5e9 / geometry.LIGHT)
    with pytest.raises(ValueError, match="no field"):
        baselines.longest_projections(o, 99)
    # at noon of the first of January 2000 Greenwich has 18 h 41 min 50.55 s
    assert baselines.sidereal_angle(51_544.5 * 86_400, 0.0) == pytest.approx(math.radians((18 + 41 / 60 + 50.548 / 3600) * 15), abs=1e-6)
