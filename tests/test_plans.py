import math
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridspark.operators import interpolate
from gridspark.operators.quality import input_fingerprints, layer_fingerprints
from gridspark.operators.stations import keep_flags
from gridspark.plans import fields, run, validation
from gridspark.plans.grids import grid_table
from gridspark.plans.heatstress import LAYERS, heat_stress
from gridspark.session import materialise
from gridspark.sources import sinks
from gridspark.streaming.incremental import stream_days
from gridspark.streaming.live_metrics import live_metrics

c = F.col
DAYS = [date(2010, 7, 2), date(2010, 7, 3)]
FINE = [(40.0 + 0.008 * i, -100.0 + 0.008 * j) for i in range(3) for j in range(3)]


@pytest.fixture(scope="module")
def inputs(spark):
    """A 3 x 3 grid with two complete days; counters reach the next day's hour 0."""
    utc = [date(2010, 7, 1) + timedelta(n) for n in range(3)]
    coarse_cells = [(0, 39.9, -100.1), (1, 39.9, -99.9), (2, 40.1, -100.1), (3, 40.1, -99.9), (4, 40.01, -99.99)]
    coarse = [
        (lat, lon, s, d, h, 20.0 + 8 * math.sin(h / 24 * 6.28) + s, 10.0 + s, 9.5e4, 2.0, 1.0 + s, -2e5 * (h or 24), 1.2e6 * (h or 24))
        for s, lat, lon in coarse_cells for d in utc for h in range(24)]
    half = [(p, d, s, 400.0, 100.0, 500.0, 4000.0, 200.0) for p in range(3) for d in utc for s in range(48)]
    cells = spark.createDataFrame(FINE, "lat double, lon double")
    sources = spark.createDataFrame(coarse_cells, "src_id int, lat double, lon double")
    points = spark.createDataFrame([(p, 40.0 + 0.01 * p, -100.0) for p in range(3)], "point int, lat double, lon double")
    daily = [(lat, lon, d, 15.0, 30.0, 12.0 if k else None) for d in DAYS for k, (lat, lon) in enumerate(FINE)]
    return run.Inputs(
        daily=spark.createDataFrame(daily, "lat double, lon double, prism_day date, tmin double, tmax double, tdmean double"),
        coarse=spark.createDataFrame(coarse, "lat double, lon double, src_id int, d date, hr int, t2m double, d2m double, sp double, u10 double, v10 double, str double, strd double"),
        coarse_grid=sources.where("src_id < 4").select("lat", "lon"),
        half_hours=spark.createDataFrame(half, "point int, d date, slot int, ghi double, dhi double, dni double, sza double, alb double"),
        weather_nn=materialise(fields.neighbour_table(cells, sources, ["lat", "lon"], "src_id")),
        radiation_nn=materialise(fields.neighbour_table(cells, points, ["lat", "lon"], "point")),
        cell_regions=cells.withColumn("tract_code", F.when(c("lat") > 40.01, 1).otherwise(0)),
        codes=spark.createDataFrame([(0, "A"), (1, "B")], "tract_code int, GEOID string"),
        population=cells.withColumns({"yr": F.lit(2010), "pop": F.lit(3.0)}),
    )


def days_of(spark, days=DAYS):
    return spark.createDataFrame([(d,) for d in days], "prism_day date")


def test_hourly_inputs_by_both_plans(spark, inputs, monkeypatch):
    keys = ["lat", "lon", "prism_day", "ph"]
    # One source lacks an hour's temperature, another a wind reading, a point a half-hour.
    gaps = replace(
        inputs,
        coarse=inputs.coarse.withColumns({
            "t2m": F.when(~((c("src_id") == 3) & (c("hr") == 5)), c("t2m")),
            "u10": F.when(~((c("src_id") == 4) & (c("hr") == 7)), c("u10"))}),
        half_hours=inputs.half_hours.where("NOT (point = 1 AND slot = 20)"))
    for given in (inputs, gaps):
        joined = materialise(run.hourly_inputs(given, given.daily, days_of(spark)))
        assert joined.count() == 8 * 2 * 24  # one cell has no mean dewpoint
        separate = materialise(run.hourly_inputs(given, given.daily, days_of(spark), broadcast_bytes=0))
        assert separate.count() == joined.count()
        both = joined.join(separate.withColumnsRenamed({v: f"{v}_2" for v in LAYERS}), keys, "full")
        assert both.count() == 384
        for v in LAYERS:
            same = c(v).eqNullSafe(c(f"{v}_2")) | (F.abs(c(v) - c(f"{v}_2")) <= 1e-9)
            assert both.where(~F.coalesce(same, F.lit(False))).count() == 0, v
    assert joined.where("t2m is null").count() > 0
    r = materialise(run.hourly_inputs(inputs, inputs.daily, days_of(spark))).agg(F.min("t2m").alias("a"), F.max("t2m").alias("b"), F.min("lwdown").alias("d"), F.max("lwnet").alias("n"), F.max("sza").alias("z")).first()
    assert (r.a, r.b) == (15, 30) and r.d == pytest.approx(1.2e6 / 3600) and r.n == pytest.approx(-2e5 / 3600) and r.z == pytest.approx(40)


def test_one_day_reads_two_partitions(spark, inputs, tmp_path):
    path = str(tmp_path / "coarse")
    inputs.coarse.write.partitionBy("d").parquet(path)
    stored = run.utc_days(spark.read.parquet(path), days_of(spark, DAYS[:1]))
    assert {r.d for r in stored.select("d").distinct().collect()} == {DAYS[0], DAYS[0] - timedelta(1)}
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_heat_stress_missing_inputs(spark):
    good = dict(t2m=30.0, ea=20.0, sp=1e5, u10=2.0, v10=1.0, lwdown=400.0, lwnet=-60.0, ghi=600.0, dhi=100.0, dni=700.0, sza=30.0, alb=0.2)
    cases = {"all": good, "no albedo": {**good, "alb": None}, "no diffuse": {**good, "dhi": None}, "no ghi": {**good, "ghi": None},
             "no pressure": {**good, "sp": None}, "calm": {**good, "u10": 0.0, "v10": 0.1}}
    df = spark.createDataFrame([(k, *v.values()) for k, v in cases.items()], "id string, " + ", ".join(f"{k} double" for k in good))
    out = {r.id: r for r in heat_stress(df, radiant=True).collect()}
    assert out["all"].HI_C == pytest.approx(31.1, abs=0.5) and 20 < out["all"].WBGT_C < 35 and 30 < out["all"].UTCI_C < 42
    assert out["no albedo"].UTCI_C is None and out["no albedo"].WBGT_C is not None
    assert out["no diffuse"].UTCI_C == out["all"].UTCI_C and out["no diffuse"].WBGT_C is None
    assert out["no pressure"].UTCI_C is not None and out["no pressure"].WBGT_C is None
    assert out["no ghi"].UTCI_C is None and out["calm"].UTCI_C is None and out["all"].TMRT_C > 30


def test_run_writes_skips_and_checks(spark, inputs, tmp_path):
    path = str(tmp_path / "out")
    long = str(tmp_path / "long")
    assert run.run_days(spark, inputs, days_of(spark, DAYS[:1]), path, 2010, long_path=long) == 1
    kept = spark.read.parquet(long)
    assert kept.count() == 8 * 24 and set(sinks.LONG_COLUMNS) <= set(kept.columns)
    assert run.run_days(spark, inputs, days_of(spark), path, 2010) == 1
    assert run.run_days(spark, inputs, days_of(spark), path, 2010) == 0
    out = spark.read.parquet(path)
    assert out.count() == 2 * 2 * 24 and {r.pop_year for r in out.select("pop_year").distinct().collect()} == {2010}
    assert out.where("WBGT_C_area is null or UTCI_C_pop is null or temp_C_used_area is null").count() == 0
    assert out.where("temp_C_used_area < 15 or temp_C_used_area > 30").count() == 0
    # Another vintage, and no weights, are results of their own.
    assert run.run_days(spark, inputs, days_of(spark, DAYS[:1]), path, 2020) == 1
    assert run.run_days(spark, replace(inputs, population=None), days_of(spark, DAYS[:1]), path, 2020) == 1
    assert run.run_days(spark, replace(inputs, population=None), days_of(spark, DAYS[:1]), path, 2020) == 0
    kept = spark.read.parquet(path).where(c("prism_day") == DAYS[0]).groupBy("pop_year", "vintage").count().collect()
    assert {(r.pop_year, r.vintage) for r in kept} == {(2010, 2010), (2010, 2020), (None, 2020)}
    have = spark.createDataFrame([("tmin", DAYS[0])], "layer string, d date")
    with pytest.raises(ValueError, match="missing inputs"):
        run.run_days(spark, inputs, days_of(spark), str(tmp_path / "other"), 2010, available=have)


def test_run_without_population(spark, inputs):
    out = materialise(run.regional_table(replace(inputs, population=None), days_of(spark, DAYS[:1])))
    assert out.where("HI_C_pop is not null").count() == 0 and out.where("HI_C_area is not null").count() == 48
    gaps = inputs.population.where("lat > 40.001")
    with pytest.raises(ValueError, match="population"):
        run.regional_table(replace(inputs, population=gaps), days_of(spark, DAYS[:1]))


def test_days_stream_runs_each_day_once(spark, inputs, tmp_path):
    arrivals, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    seen = []

    def process(days):
        seen.extend(r.prism_day for r in days.collect())
        sinks.write_regions(run.regional_table(inputs, days), out, 2010)

    for batch in (DAYS[:1], DAYS, []):
        if batch:
            days_of(spark, batch).write.mode("append").parquet(arrivals)
        stream_days(spark, arrivals, out, ckpt, process).awaitTermination()
    assert seen == DAYS
    assert sinks.finished_days(spark, out).count() == 2
    # Under another vintage the days are not finished.
    label = lambda days: run.labelled(inputs, days, 2020)
    stream_days(spark, arrivals, out, str(tmp_path / "ckpt2"), process, label=label).awaitTermination()
    assert sorted(seen) == sorted(DAYS * 2)


def test_live_metrics_stream_equals_batch(spark, tmp_path):
    rows = [(1, datetime(2010, 7, 1, 0) + timedelta(hours=h), 20.0 + h % 5) for h in range(96)]
    obs = spark.createDataFrame(rows, "key int, time_utc timestamp_ntz, temp_C_obs double").withColumn("hour_utc", c("time_utc"))
    obs.write.parquet(str(tmp_path / "obs"))
    static = obs.select("key", "hour_utc", (c("temp_C_obs") + 2).alias("temp_C_model"))
    batch = live_metrics(obs, static, "temp_C_obs", "temp_C_model")
    days = {r.prism_day: r for r in batch.collect()}
    assert days[date(2010, 7, 1)].n == 12 and days[date(2010, 7, 2)].n == 24  # 12:00 opens the next day
    assert days[date(2010, 7, 2)].bias == 2 and days[date(2010, 7, 2)].rmse == 2
    stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "obs"))
    query = (live_metrics(stream, static, "temp_C_obs", "temp_C_model").writeStream.outputMode("append").format("memory")
             .queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    query.awaitTermination()
    closed = {r.prism_day: r.n for r in spark.table("live").collect()}
    assert closed and all(days[d].n == n for d, n in closed.items()) and max(days) not in closed


def test_validation_of_two_networks(spark, tmp_path):
    cells = spark.createDataFrame([(40.0, -100.0), (40.1, -100.0)], "lat double, lon double")
    grid = grid_table(cells)
    places = spark.createDataFrame(
        [("a", 40.001, -100.0), ("b", 40.0, -100.002), ("far", 40.04, -100.0)], "station_id string, LAT double, LON double")
    mapped = validation.map_stations(validation.map_stations(places, grid, "model"), grid, "era")
    flags = {r.station_id: r for r in keep_flags(mapped).collect()}
    assert flags["a"].dist_m_model == pytest.approx(111.1, abs=1) and flags["a"].keep_both and not flags["far"].keep_model
    times = [datetime(2010, 7, 1, h) for h in range(24)]
    key = grid.where("lat < 40.05").first().key
    predicted = spark.createDataFrame([(key, t, 21.0, 12.0, 50.0) for t in times], "key long, time_utc timestamp_ntz, temp_C double, ea_hPa double, rh_pct double")
    as_product = lambda s: predicted.select("key", "time_utc", F.lit(None).cast("date").alias("prism_day"), *[c(v).alias(f"{v}_{s}") for v in validation.MET])
    observed = spark.createDataFrame(
        [(s, t, 20.0, 12.5, None) for s in ("a", "b", "far") for t in times],
        "station_id string, time_utc timestamp_ntz, temp_C_obs double, ea_hPa_obs double, rh_pct_obs double")
    windows = validation.windows_of(spark, [("2010-07-01", "2010-07-01")])
    obs = validation.in_windows(observed, windows)
    assert obs.count() == 36  # hours from 12:00 on belong to the next day
    found = validation.isd_comparisons(keep_flags(mapped), obs, as_product("model"), as_product("era"))
    network = validation.network_comparison(
        obs.join(places, "station_id"), grid, as_product("model"), validation.MODEL_MET, validation.USCRN, validation.MET)
    table = validation.summary_table([*found, network], windows).collect()
    assert len(table) == 6  # humidity has no observation
    first = next(r for r in table if r["product"] == validation.MODEL_MET and r.reference == "ISD-Lite" and r.variable.startswith("Air"))
    assert (first.n_stations, first.n_hours, first.bias, first.rmse) == (2, 24, 1, 1) and first.window_label == "2010 Jul 01–01 (JJA)"
    era = next(r for r in table if r["product"] == validation.COARSE_MET and r.variable.startswith("Air"))
    assert era.n_stations == 3
    assert validation.published(validation.summary_table(found, windows)).columns[0] == "Temporal window"
    assert validation.tagged(windows).first().tag == "2010-07-01"
    folder = str(tmp_path)
    validation.write_comparison(network, windows, folder, "met")
    csv = lambda name: spark.read.option("header", True).csv(f"{folder}/{name}")
    assert {r.station_id for r in csv("stations_met").collect()} == {"a", "b"}
    overall = {r["var"]: r for r in csv("metrics_overall_met_2010-07-01").collect()}
    assert float(overall["temp_C"]["met_bias"]) == 1 and int(overall["temp_C"]["met_N"]) == 24
    assert csv("metrics_by_station_met_2010-07-01").where("var = 'temp_C'").count() == 2
    assert csv("metrics_by_day_met_2010-07-01").where("var = 'temp_C'").count() == 1
    assert spark.read.parquet(f"{folder}/pairs_met_2010-07-01").count() == 24
    with pytest.raises(ValueError):
        validation.windows_of(spark, [("2010-07-02", "2010-07-01")])


def test_tiles_split_until_they_are_small(spark):
    cells = spark.createDataFrame([(40 + 0.001 * i, -100 + 0.001 * j) for i in range(40) for j in range(40)], "lat double, lon double")
    degrees = interpolate.tile_degrees(cells, most=100)
    assert 0.002 < degrees < 0.02
    assert interpolate.with_tile(cells, degrees).groupBy(*interpolate.TILE).count().where("count > 100").isEmpty()
    assert interpolate.tile_degrees(cells) == interpolate.tile_degrees(cells.limit(0)) == interpolate.TILE_DEGREES


def test_daily_rows_cross_once(spark, inputs, monkeypatch):
    """With tile dictionaries, the only exchange with a row per cell and day is that by tile; no source values join rows by source."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = run.hourly_inputs(inputs, inputs.daily, days_of(spark), broadcast_bytes=0)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    carrying = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("_ty" in line and "prism_day" in line for line in carrying) == 4  # the rows and three dictionaries
    assert "_weather" in plan and "_sun" in plan


def test_outputs_are_decided_one_by_one(spark, inputs, tmp_path, monkeypatch):
    path, long = str(tmp_path / "out"), str(tmp_path / "long")
    calls = []
    hourly = run.hourly_inputs
    monkeypatch.setattr(run, "hourly_inputs", lambda *a, **k: calls.append(1) or hourly(*a, **k))
    assert run.run_days(spark, inputs, days_of(spark, DAYS[:1]), path, 2010) == 1
    before = spark.read.parquet(path).where(c("prism_day") == DAYS[0]).toPandas()
    assert run.run_days(spark, inputs, days_of(spark), path, 2010, long_path=long, time_mode="prism") == 2
    assert len(calls) == 2  # once for the first run, once for the cells of both days
    assert spark.read.parquet(long).groupBy("prism_day").count().count() == 2
    after = spark.read.parquet(path).where(c("prism_day") == DAYS[0]).toPandas()
    assert before.sort_values(["GEOID", "time"]).reset_index(drop=True).equals(after.sort_values(["GEOID", "time"]).reset_index(drop=True))
    one = run.regional_table(inputs, days_of(spark)).where(c("prism_day") == DAYS[1]).orderBy("GEOID", "ph").collect()
    two = spark.read.parquet(path).where(c("prism_day") == DAYS[1]).orderBy("GEOID", "time").collect()
    assert len(one) == len(two) == 48
    for a, b in zip(one, two):
        assert a.GEOID == b.GEOID and a.HI_C_pop == pytest.approx(b.HI_C_pop, rel=1e-5) and a.WBGT_C_area == pytest.approx(b.WBGT_C_area, rel=1e-4)
    # A run that died before its note was written is made again.
    (tmp_path / "out" / sinks.COMMITS).rename(tmp_path / "gone")
    sinks.record_commits(run.labelled(inputs, days_of(spark, DAYS[:1]), 2010), path)
    assert run.run_days(spark, inputs, days_of(spark), path, 2010, long_path=long, time_mode="prism") == 1
    assert len(calls) == 3  # the check above; the repeated region table comes from the stored cells


def test_changed_inputs_run_again(spark, inputs, tmp_path):
    path = str(tmp_path / "out")

    def marks(given):
        known = layer_fingerprints(given.daily, "tmin", "prism_day").unionByName(layer_fingerprints(given.coarse, "t2m"))
        return input_fingerprints(days_of(spark), known, ["tmin"], ["t2m"])

    assert {r.prism_day for r in marks(inputs).collect()} == set(DAYS)
    assert run.run_days(spark, inputs, days_of(spark), path, 2010, fingerprints=marks(inputs)) == 2
    shuffled = replace(inputs, coarse=inputs.coarse.repartition(5, "lat").select(*reversed(inputs.coarse.columns)))
    assert run.run_days(spark, shuffled, days_of(spark), path, 2010, fingerprints=marks(shuffled)) == 0
    warmer = replace(inputs, daily=inputs.daily.withColumn("tmax", F.when(c("prism_day") == DAYS[1], c("tmax") + 1).otherwise(c("tmax"))))
    assert run.run_days(spark, warmer, days_of(spark), path, 2010, fingerprints=marks(warmer)) == 1
    assert spark.read.parquet(path).where(c("prism_day") == DAYS[1]).agg(F.max("temp_C_used_area")).first()[0] == 31
    # The evening of a day belongs to the next one too, a copy of a row is a change, and so is a layer that goes.
    assert run.run_days(spark, warmer, days_of(spark), path, 2010, fingerprints=marks(replace(warmer, coarse=warmer.coarse.where(c("d") > DAYS[0] - timedelta(1))))) == 1
    doubled = warmer.daily.unionByName(warmer.daily.where(c("prism_day") == DAYS[0]).limit(1))
    found = {r.prism_day: r.fingerprint for r in marks(replace(warmer, daily=doubled)).collect()}
    assert found[DAYS[1]] == {r.prism_day: r.fingerprint for r in marks(warmer).collect()}[DAYS[1]] != found[DAYS[0]]


def test_late_rows_of_the_given_events():
    """The three arrivals of the stream query do hold rows late within the bound and rows of closed days."""
    import duckdb

    from gridspark.catalog.carriers import with_views
    from gridspark.catalog.files import _ARRIVED

    con = duckdb.connect()
    con.execute("create view events as select * from '/root/testdata/sf0.001/events.parquet'")
    late = con.execute(with_views(_ARRIVED + """
        select count(*) filter (where a.arrival = 3 and t < (select cut1 from e)),
               count(*) filter (where a.arrival = 3 and prism_day + interval 12 hour <= mark),
               count(*) filter (where a.arrival = 2 and t < (select cut1 from e) and prism_day + interval 12 hour > mark)
        from a left join w on w.arrival = a.arrival - 1""")).fetchone()
    assert min(late) > 0 and late[0] == late[1]


def test_comparisons_of_a_network_place_its_stations_once(spark, monkeypatch):
    from gridspark.catalog import checks
    from gridspark.catalog.carriers import Views
    from gridspark.plans import validation

    placed, place = [], validation.map_stations
    monkeypatch.setattr(validation, "map_stations", lambda *given: placed.append(1) or place(*given))
    _, obs, cells, model = checks._network(Views(spark, "/root/testdata/sf0.001"))
    assert len(validation.uscrn_comparisons(obs, cells, model, model)) == 2
    assert len(placed) == 1


def test_windowed_observations_are_read_from_a_stored_table(spark, monkeypatch):
    from gridspark.catalog import checks
    from gridspark.catalog.carriers import Views

    given = []
    monkeypatch.setattr(checks, "_mapped_stations", lambda v: None)
    monkeypatch.setattr(checks, "isd_comparisons", lambda stations, obs, model, coarse: given.append(obs))
    monkeypatch.setattr(checks, "summary_table", lambda comparisons, windows: None)
    checks._table(Views(spark, "/root/testdata/sf0.001"))
    assert given[0].inputFiles() and all("/table-" in f for f in given[0].inputFiles())
