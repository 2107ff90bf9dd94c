import gzip
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gridspark.functions.geo import packed_key
from gridspark.sources import layers, predictions, regions, sinks, stations

c = F.col
D0, D1 = date(2010, 7, 1), date(2010, 7, 2)


def wide(spark, var, cells, tag="h", value=lambda i, h: float(i * 100 + h)):
    names = ["lat", "lon", *[f"{var}_{tag}{h:02d}" for h in range(24)]]
    rows = [(lat, lon, *[value(i, h) for h in range(24)]) for i, (lat, lon) in enumerate(cells)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


CELLS = [(40.0, -100.0), (40.1, -100.0)]


def test_day_layer_file_names(spark, tmp_path):
    base = tmp_path / "era"
    for name, shift in (("07-01-2010", 273.15), ("2010-07-02_t2m", 300.0), ("07-02-2010_t2m", 999.0), ("notes", 1.0)):
        folder = base / "t2m" / "2010"
        folder.mkdir(parents=True, exist_ok=True)
        pdf = wide(spark, "t2m", CELLS, value=lambda i, h, s=shift: s + h if h != 7 else float("nan")).toPandas()
        pdf.to_parquet(folder / f"{name}.parquet")
    listed = {r.d: r.path for r in layers.list_layer_days(spark, str(base), "t2m").collect()}
    assert set(listed) == {D0, D1} and "2010-07-02_t2m" in listed[D1]  # the ISO form is preferred
    rows = layers.read_day_layers(spark, str(base), "t2m", "2010-07-01", "2010-07-02", kelvin=True)
    assert rows.count() == 96
    got = {(r.d, r.hr): r.t2m for r in rows.where("lat = 40.0").collect()}
    assert got[D0, 3] == pytest.approx(3) and got[D0, 7] is None and got[D1, 0] == pytest.approx(26.85)
    with pytest.raises(ValueError, match="no t2m layer"):
        layers.read_day_layers(spark, str(base), "t2m", "2010-07-01", "2010-07-03")


def test_duplicate_coordinates_are_rejected(spark):
    df = wide(spark, "d2m", [CELLS[0], CELLS[0]]).withColumn("d", F.lit(D0))
    with pytest.raises(ValueError, match="duplicate"):
        layers.day_layer_rows(df, "d2m", reject_duplicates=True)


def test_daily_cells(spark):
    cell = lambda v: spark.createDataFrame([(0, 0, D0, v), (0, 1, D0, -9999.0)], "row int, col int, prism_day date, value double")
    out = {r.col: r for r in layers.daily_cells(cell(1.0), cell(2.0), cell(3.0), -9999.0, (50.0, -120.0), (-0.5, 0.5)).collect()}
    assert (out[0].tmin, out[0].tmax, out[0].tdmean, out[0].lat, out[0].lon) == (1, 2, 3, 49.75, -119.75)
    assert (out[1].tmin, out[1].tmax) == (None, None)
    with pytest.raises(Exception, match="same cells"):
        layers.daily_cells(cell(1.0), cell(2.0).where("col = 0"), cell(3.0), None, (0.0, 0.0), (1.0, 1.0)).collect()


def test_point_layers(spark, tmp_path):
    for day in ("2010-07-01", "2010-07-02"):
        folder = tmp_path / "2010" / day
        folder.mkdir(parents=True)
        for name in layers.POINT_FILES.values():
            spark.createDataFrame(
                [(5, *[float(i) for i in range(48)])], "point long, " + ", ".join(f"ts_{i:03d} double" for i in range(48))
            ).toPandas().to_parquet(folder / name)
    rows = layers.read_point_layers(spark, str(tmp_path), "2010-07-02", "2010-07-02")
    assert rows.count() == 48 and set(layers.POINT_FILES) <= set(rows.columns)
    assert rows.where("slot = 47").first().ghi == 47 and rows.select("d").distinct().first().d == D1
    with pytest.raises(ValueError, match="no half-hourly layer"):
        layers.read_point_layers(spark, str(tmp_path), "2010-07-02", "2010-07-03")
    meta = spark.createDataFrame([(1, 40.0, -100.0), (2, None, -100.0), (3, 1.0, float("nan"))], "point long, latitude double, longitude double")
    assert [r.point for r in layers.point_metadata(meta).collect()] == [1]
    assert layers.target_grid(wide(spark, "x", [CELLS[0], CELLS[0]])).count() == 1


def test_point_layers_written_by_spark(spark, tmp_path):
    names = ", ".join(f"ts_{i:03d} double" for i in range(48))
    for var, name in layers.POINT_FILES.items():
        points = [5] if var == "alb" else [5, 6]
        spark.createDataFrame([(p, *[float(i) for i in range(48)]) for p in points], f"point long, {names}").write.parquet(
            str(tmp_path / "2010" / "2010-07-01" / name))
    rows = layers.read_point_layers(spark, str(tmp_path), "2010-07-01", "2010-07-01")
    assert rows.count() == 96 and rows.where("point = 6 and alb is null and ghi is not null").count() == 48
    spark.createDataFrame([(5, *[1.0] * 48)], f"point long, {names}").write.mode("append").parquet(
        str(tmp_path / "2010" / "2010-07-01" / "ghi.parquet"))
    with pytest.raises(Exception, match="duplicate"):
        layers.read_point_layers(spark, str(tmp_path), "2010-07-01", "2010-07-01").count()


def test_region_tables(spark, tmp_path):
    spark.createDataFrame([(1, 7, 2010), (2, -1, 2010), (1, 9, 2020)], "key long, tract_code int, vintage int").write.partitionBy("vintage").parquet(str(tmp_path / "map"))
    spark.createDataFrame([(7, "G7", 2010)], "tract_code int, GEOID string, vintage int").write.partitionBy("vintage").parquet(str(tmp_path / "lut"))
    spark.createDataFrame([("G7", 1.0, 2.0)], "GEOID string, lat float, lon float").write.parquet(str(tmp_path / "rep"))
    assert sorted(r.tract_code for r in regions.read_region_map(spark, str(tmp_path / "map"), 2010).collect()) == [-1, 7]
    assert regions.read_region_codes(spark, str(tmp_path / "lut"), 2010).first().GEOID == "G7"
    assert regions.read_representative_points(spark, str(tmp_path / "rep")).first().lon == 2


def test_population_years(spark):
    have = spark.createDataFrame([(2000,), (2005,)], "yr int")
    ask = lambda *ys: spark.createDataFrame([(y,) for y in ys], "yr int")
    got = {r.yr: (r.pop_year, r.problem) for r in regions.resolve_population_years(ask(1998, 2000, 2005, 2006, 2021), have, strict=False).collect()}
    assert got[1998] == (2000, None) and got[2005] == (2005, None)
    assert got[2006][1] == "no population for the year" and got[2021][1] == "population ends at 2020"
    with pytest.raises(Exception, match="population ends at 2020: 2021"):
        regions.resolve_population_years(ask(2021), have).collect()


def test_station_history(spark, tmp_path):
    (tmp_path / "history.csv").write_text(
        "USAF,WBAN,STATION NAME,CTRY,LAT,LON,BEGIN,END\n"
        "123,45,A,US,40.0,-100.0,19900101,20201231\n"
        "124,45,B,US,,-100.0,19900101,20201231\n"
        "125,45,C,CA,40.0,-100.0,19900101,20201231\n"
        "126,45,D,US,65.0,-150.0,19900101,20201231\n"
        "127,45,E,US,40.0,-100.0,20100102,20201231\n"
        "128,45,F,US,40.0,-100.0,junk,20201231\n")
    read = lambda **k: sorted(r.station_id for r in stations.read_station_history(spark, str(tmp_path / "history.csv"), "2010-01-01", "2010-12-31", **k).collect())
    assert read() == ["000123-00045"]
    assert read(conus_only=False) == ["000123-00045", "000126-00045"]


def test_isd_lite_files(spark, tmp_path):
    text = ("2010 07 15 12   205   123 10132   200    36     0 -9999 -9999\n"
            "2010 07 15 13 -9999   123 10132   200    36     0 -9999 -9999\n"
            "2010 07 15 14   205 -9999 10132   200    36     0 -9999 -9999\n"
            "2010 13 15 14   205   100 10132   200    36     0 -9999 -9999\n")
    with gzip.open(tmp_path / "012345-00099-2010.gz", "wt") as f:
        f.write(text)
    out = stations.read_isd_lite(spark, str(tmp_path)).orderBy("time_utc").collect()
    assert [r.time_utc for r in out] == [datetime(2010, 7, 15, 12), datetime(2010, 7, 15, 14)]
    assert out[0].station_id == "012345-00099" and out[0].temp_C_obs == 20.5
    assert out[0].rh_pct_obs == pytest.approx(59.3, abs=0.3) and out[1].rh_pct_obs is None
    for name in ("012345-00099-2011", "012346-00099-2010"):
        with gzip.open(tmp_path / f"{name}.gz", "wt") as f:
            f.write(text.replace("2010 07", f"{name[-4:]} 07"))
    chosen = stations.read_isd_lite(spark, str(tmp_path), ["012345-00099"], [2010])
    assert {(r.station_id, r.time_utc.year) for r in chosen.collect()} == {("012345-00099", 2010)} and chosen.count() == 2
    assert stations.read_isd_lite(spark, str(tmp_path), years=[2010, 2011]).count() == 6


def test_heat01_files(spark, tmp_path):
    line = lambda wban, when, t, rh="50": f"{wban},{when},-100.0,40.0,{rh},1000,500,2,{t},30,31,25,1,1,1,1\n"
    (tmp_path / "CRNHE0101-TX_Austin.csv").write_text(
        ",".join(stations.HEAT01_COLUMNS) + "\n" + line(3047, "2010071512", "30.5") + line(3047, "2010071513", "-9999")
        + line(3047, "2010071599", "30.5") + line(3047, "2010071514", "30.5", " -9999") + line(3047, "2011071514", "30.5")
        + "broken,line\n")
    (tmp_path / "CRNHE0101-AK_Barrow.csv").write_text(line(1, "2010071512", "1.0"))
    out = stations.read_heat01(spark, str(tmp_path), 2010).collect()
    assert [(r.station_id, r.time_utc, r.temp_C_obs) for r in out] == [("03047", datetime(2010, 7, 15, 12), 30.5)]
    assert out[0].ea_hPa_obs == pytest.approx(21.8, abs=0.1)


def test_radiation_station_names(spark, tmp_path):
    df = spark.createDataFrame(
        [("bon", datetime(2010, 7, 1, 1), 40.0, -88.0, 50.0, 30.0), ("sxf", datetime(2010, 7, 1, 1), float("nan"), -96.0, 50.0, 30.0)],
        "station string, timestamp_utc timestamp_ntz, lat double, lon double, TMRT_C double, UTCI_C double")
    df.write.parquet(str(tmp_path / "SURFRAD_hourly_TMRT_UTCI_2010.parquet"))
    out = stations.read_radiation_stations(spark, str(tmp_path), 2010)
    assert out.columns == ["station_id", "time_utc", "LAT", "LON", "TMRT_C_obs", "UTCI_C_obs"]
    assert [r.station_id for r in out.collect()] == ["bon"]
    assert tuple(stations.stations_without_coordinates(df).first()) == ("sxf", 1)
    with pytest.raises(KeyError):
        stations.load_radiation_stations(df.drop("UTCI_C"))


def test_year_cache_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("b", datetime(2010, 1, 2)), ("a", datetime(2010, 1, 1))], "station_id string, time_utc timestamp_ntz")

    path = str(tmp_path / "cache")
    for _ in range(2):
        assert stations.cached_year(spark, path, 2010, build).count() == 2
    assert len(calls) == 1
    stations.cached_year(spark, path, 2011, build)
    stations.cached_year(spark, path, 2010, build, force=True)
    assert len(calls) == 3 and stations.cached_year(spark, path, 2011, build).count() == 2


def test_wide_predictions(spark, tmp_path):
    for var in ("t2m", "ea"):
        for day in ("2010-07-01", "2010-07-02"):
            if (var, day) != ("ea", "2010-07-02"):
                wide(spark, var, CELLS, "ph", lambda i, h: 20.0 + i).withColumn("prism_day", F.lit(day).cast("date")).toPandas().to_parquet(
                    tmp_path / f"{var}_prismday_{day}.parquet")
    wanted = spark.createDataFrame([CELLS[1]], "lat double, lon double").select(packed_key(c("lat"), c("lon")).alias("key"))
    read = lambda **k: predictions.read_wide_predictions(
        spark, str(tmp_path), "{var}_prismday_{date}.parquet", {"t2m": "t2m", "ea": "ea"}, "2010-07-01", "2010-07-03", **k)
    out = read(wanted=wanted)
    assert out.count() == 24 and out.select("prism_day").distinct().first()[0] == D0  # the day without ea is skipped
    first = out.orderBy("time_utc").first()
    assert first.time_utc == datetime(2010, 6, 30, 12) and first.temp_C_model == 21 and first.rh_pct_model == pytest.approx(84.4, abs=0.2)
    assert read(wanted=None).count() == 48
    with pytest.raises(ValueError, match="date"):
        predictions.list_pattern(spark, str(tmp_path), "{var}.parquet", "t2m")


def test_coarse_predictions(spark, tmp_path):
    for var in ("t2m", "d2m"):
        for day in ("2010-07-01", "2010-07-02"):
            folder = tmp_path / var / "2010"
            folder.mkdir(parents=True, exist_ok=True)
            wide(spark, var, CELLS, value=lambda i, h: 290.0 + h).toPandas().to_parquet(folder / f"{day}.parquet")
    out = predictions.read_coarse_predictions(spark, str(tmp_path), "2010-07-01", "2010-07-03", None)
    assert out.count() == 48 and {r.prism_day for r in out.collect()} == {D1}
    first = out.orderBy("time_utc").first()
    assert first.time_utc == datetime(2010, 7, 1, 12) and first.temp_C_era == pytest.approx(28.85) and first.rh_pct_era == 100


def test_sinks_replace_only_their_days(spark, tmp_path):
    path = str(tmp_path / "long")

    def table(day, value):
        row = (40.0, -100.0, day, 0, value, 50.0, 1.0, 2.0, None)
        return spark.createDataFrame([row], "lat double, lon double, prism_day date, ph int, temp_C_used double, rh_pct_used double, HI_C double, WBGT_C double, UTCI_C double")

    assert sinks.finished_days(spark, path).count() == 0
    sinks.write_long(table(D0, 1.0).union(table(D1, 1.0)), path)
    sinks.write_long(table(D1, 9.0), path)
    back = {r.prism_day: r for r in spark.read.parquet(path).collect()}
    assert back[D0].temp_C_used == 1 and back[D1].temp_C_used == 9
    assert (back[D1].month, back[D1].day, back[D1].time) == (7, 1, 12)  # UTC hour of position 0
    types = dict(spark.read.parquet(path).dtypes)
    assert types["lat"] == "float" and types["year"] == "smallint" and types["time"] == "tinyint"
    assert {r.prism_day for r in sinks.finished_days(spark, path).collect()} == {D0, D1}
    long = predictions.long_predictions(spark.read.parquet(path), None)
    assert long.where("temp_C_model = 9").first().time_utc == datetime(2010, 7, 1, 12)
    with pytest.raises(KeyError):
        predictions.long_predictions(spark.read.parquet(path).drop("HI_C"), None)


def test_long_files_by_pattern(spark, tmp_path):
    row = (40.0, -100.0, 1, 7, 2010, 12, 5.0)
    spark.createDataFrame([row], "lat double, lon double, day int, month int, year int, time int, UTCI_C double").toPandas().to_parquet(tmp_path / "metrics_2010-07-02.parquet")
    read = lambda **k: predictions.read_long_predictions(spark, str(tmp_path), "metrics_{date}.parquet", "2010-07-01", "2010-07-02", None, ["UTCI_C"], **k)
    assert tuple(read().select("prism_day", "time_utc", "UTCI_C_model").first()) == (D1, datetime(2010, 7, 1, 12), 5.0)
    with pytest.raises(ValueError, match="no prediction file"):
        read(skip_missing=False)


def test_layer_and_reports(spark, tmp_path):
    hourly = spark.createDataFrame([(40.0, -100.0, D0, h, float(h)) for h in range(24)], "lat double, lon double, prism_day date, ph int, v double")
    sinks.write_layer(hourly, str(tmp_path / "layer"), "v", "t2m")
    back = spark.read.parquet(str(tmp_path / "layer")).first()
    assert back.t2m_ph23 == 23 and back.prism_day == D0
    sinks.write_suite({"overall": spark.createDataFrame([("t", 1)], "var string, N int")}, str(tmp_path), "m", "x")
    assert spark.read.csv(str(tmp_path / "metrics_overall_m_x"), header=True).first()["var"] == "t"
    sinks.write_pairs(hourly, str(tmp_path / "pairs"))
    sinks.write_pairs(hourly, str(tmp_path / "pairs_csv"), as_csv=True)
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 24


def scanned(df):
    """Rows that the file scan of df hands on, after row groups are left out by their statistics and filters."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(n).metrics().apply("numOutputRows").value() for n in range(leaves.size()))


def test_z_curve_keeps_neighbours_together(spark):
    from gridspark.functions.geo import interleaved

    places = [(-90.0, -180.0), (0.0, 0.0), (40.01, -100.02), (89.9, 179.99), (None, 1.0)]
    got = spark.createDataFrame([(a, b) for a, b in places], "lat double, lon double").select(
        "lat", "lon", interleaved(F.col("lat"), F.col("lon")).alias("z")).collect()
    for r in got:
        if r.lat is None:
            assert r.z is None
            continue
        a, b = (int((x + 180) * 65536 // 360) for x in (r.lat, r.lon))
        assert r.z == sum((a >> n & 1) << 2 * n + 1 | (b >> n & 1) << 2 * n for n in range(16))


def test_lookups_read_few_row_groups(spark, tmp_path):
    """Rows scanned for a box and for single cells, against the same rows in the order of time."""
    from gridspark.functions.geo import packed_key

    cells = spark.range(40_000).select((30 + F.floor(F.col("id") / 200) * 0.04).alias("lat"), (-110 + F.col("id") % 200 * 0.04).alias("lon"))
    rows = cells.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("key", packed_key(F.col("lat"), F.col("lon")))
    by_time, by_place = str(tmp_path / "time"), str(tmp_path / "place")
    rows.repartitionByRange(4, "hour").sortWithinPartitions("hour", F.hash("key")).write.option("parquet.block.size", 1 << 18).parquet(by_time)
    sinks.write_for_lookups(rows, by_place, "key", 4, row_group_bytes=1 << 18, keys_in_group=20_000)
    box = "lat between 32 and 33 and lon between -108 and -107"
    keys = [r.key for r in rows.where("lat between 34 and 34.01 and lon between -106 and -105.9 or lat < 30.01 and lon < -109.97").select("key").distinct().collect()]
    for condition in (F.expr(box), F.col("key").isin(keys)):
        old, new = (spark.read.parquet(p).where(condition) for p in (by_time, by_place))
        assert sorted(map(tuple, old.select("key", "hour").collect())) == sorted(map(tuple, new.select("key", "hour").collect()))
        assert scanned(new) * 4 < scanned(old) == 200_000
