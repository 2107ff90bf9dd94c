import math
import random
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspark.operators import neighbours as nb
from gridspark.operators.accumulate import deaccumulate, longwave
from gridspark.operators.align import align_layers, align_to_sources, join_layers
from gridspark.operators.axis import axis_nearest, with_bucket
from gridspark.operators.calendar import day_spine, doy_spine, present_both_days, realign
from gridspark.operators.interpolate import idw, pack_hours
from gridspark.operators.metrics import all_metrics, metrics_suite, paired_metrics, summary_rows
from gridspark.operators.percentile import exact_percentiles
from gridspark.operators.quality import (
    match_counts,
    days_to_run, duplicate_keys, match_rate, missing_inputs, require_covered, require_unique, worst_groups,
)
from gridspark.operators.regions import attach_population, region_means, tract_table, value_columns
from gridspark.operators.reshape import half_hour_to_hour, hour_columns, long_to_wide, wide_to_long
from gridspark.operators.stations import first_coordinates, keep_flags, on_stations, spread_subset
from gridspark.operators.templates import day_anomalies, downscale, full_day_mean, hourly_template
from gridspark.sources.sinks import write_bucketed

c = F.col
D0, D1, D2 = date(2010, 7, 1), date(2010, 7, 2), date(2010, 7, 3)


def test_hour_columns():
    names = ["lat", *[f"t_h{h:02d}" for h in reversed(range(24))], "u_h00", "t_hours"]
    assert hour_columns(names, ["u", "t"]) == [f"t_h{h:02d}" for h in range(24)]
    with pytest.raises(ValueError):
        hour_columns(names, ["u"])


def test_wide_and_long_round_trip(spark, rows):
    long = spark.createDataFrame([(1, h, float(h)) for h in range(24) if h != 5], "id int, hr int, v double")
    wide = long_to_wide(long, ["id"], "v", "hr", "v_h")
    back = wide_to_long(wide, ["id"], hour_columns(wide.columns, ["v"]), "v")
    assert back.count() == 24 and back.where("hr = 5").first().v is None
    assert rows(back.where("v is not null").select("id", "hr", "v")) == rows(long)


def test_half_hours(spark):
    df = spark.createDataFrame(
        [(1, 0, 100.0, 200.0, 6000.0), (1, 1, 200.0, 1200.0, 9000.0), (1, 2, 100.0, None, 1.0), (1, 3, None, 1.0, None)],
        "p int, slot int, ghi double, alb double, sza double")
    out = {r.hr: r for r in half_hour_to_hour(df, ["p"], {"ghi": "flux", "alb": "albedo", "sza": "zenith"}).collect()}
    assert (out[0].ghi, out[0].alb) == (150, 0.6) and out[0].sza == pytest.approx(75.5225, abs=1e-4)
    assert (out[1].ghi, out[1].alb, out[1].sza) == (None, None, None)


def test_deaccumulation(spark):
    rows = [(1, D0, 0, 900.0), (1, D0, 1, 3600.0), (1, D0, 2, 10800.0), (1, D0, 23, 90000.0), (1, D1, 0, 97200.0), (1, D1, 2, 1.0)]
    df = spark.createDataFrame(rows, "id int, d date, hr int, acc double")
    out = {(r.d, r.hr): r.acc for r in deaccumulate(df, ["id"], ["acc"]).collect()}
    assert out == {(D0, 0): 1.0, (D0, 1): 2.0, (D0, 2): None, (D0, 23): 2.0, (D1, 0): None, (D1, 2): None}


def test_fluxes_add_up_to_the_last_reading(spark):
    rng = random.Random(3)
    acc, total = [], 0.0
    for h in range(24):
        total = rng.uniform(0, 5e5) if h == 1 else total + rng.uniform(0, 1e6)
        acc.append((1, D0, h, total if h else 123.0))
    out = deaccumulate(spark.createDataFrame(acc, "id int, d date, hr int, v double"), ["id"], ["v"])
    assert out.where("hr < 23").agg(F.sum("v")).first()[0] * 3600 == pytest.approx(total)


def test_longwave_signs(spark):
    rows = [(1, D0, 0, 0.0, 0.0), (1, D0, 1, -360000.0, 1080000.0), (1, D0, 2, -720000.0, 1000000.0)]
    out = {r.hr: r for r in longwave(spark.createDataFrame(rows, "id int, d date, hr int, str double, strd double"), ["id"]).collect()}
    assert (out[0].lwnet, out[0].lwdown, out[0].lwup) == (-100, 300, 400)
    assert out[1].lwdown is None and out[1].lwup == pytest.approx(-80000 / 3600 + 100)


def test_day_spine(spark):
    assert [r.prism_day for r in day_spine(spark, "2010-12-31", "2011-01-01").collect()] == [date(2010, 12, 31), date(2011, 1, 1)]
    assert doy_spine(spark, 2012, 366, 366).first().prism_day == date(2012, 12, 31)
    with pytest.raises(ValueError):
        day_spine(spark, "2011-01-02", "2011-01-01")


def test_realign_needs_both_days(spark, rows):
    df = spark.createDataFrame([(1, D0, 12), (1, D1, 0), (1, D1, 23), (2, D0, 13)], "id int, d date, hr int")
    out = present_both_days(realign(df), ["id"])
    assert rows(out) == [(1, D1, 0), (1, D1, 12)]


@pytest.mark.parametrize("value, line", [(-5.0, 0.0), (0.5, 1.0), (0.4, 0.0), (9.0, 2.0), (2.0, 2.0)])
def test_axis_edges_and_ties(spark, value, line):
    grid = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "g double")
    out = axis_nearest(spark.createDataFrame([(value,), (None,)], "v double"), grid, "v", "g", "near").collect()
    assert [(r.v, r.near) for r in out] == [(value, line)]


def test_axis_of_one_line_and_clustered_lines(spark):
    v = spark.createDataFrame([(float(x) / 7,) for x in range(-50, 900)], "v double")
    assert {r.near for r in axis_nearest(v, spark.createDataFrame([(3.0,)], "g double"), "v", "g", "near").collect()} == {3.0}
    lines = sorted({round(random.Random(1).random() * 1e-3 * i, 7) for i in range(60)} | {100.0, 55.5})
    out = axis_nearest(v, spark.createDataFrame([(g,) for g in lines], "g double"), "v", "g", "near").collect()
    assert len(out) == 950
    for r in out:
        assert abs(r.near - r.v) == pytest.approx(min(abs(g - r.v) for g in lines))


def brute(targets, sources, k):
    return {t: [(pytest.approx(d), s) for d, s in sorted((math.hypot(x - a, y - b), s) for s, a, b in sources)[:k]]
            for t, x, y in targets}


def found(df):
    return {r.t: [(e.dist, e.id) for e in r.nn] for r in df.collect()}


def layout(kind, rng, n):
    if kind == "uniform":
        return [(rng.uniform(0, 1e5), rng.uniform(0, 1e5)) for _ in range(n)]
    if kind == "hot spot":  # two thirds of the points in one small place, the rest far around
        return [(rng.gauss(2e4, 30), rng.gauss(2e4, 30)) if i % 3 else (rng.uniform(0, 1e6), rng.uniform(0, 1e6)) for i in range(n)]
    if kind == "copies":  # a third of the points share one place
        return [(5e3, 5e3) if i % 3 == 0 else (rng.uniform(0, 1e4), rng.uniform(0, 1e4)) for i in range(n)]
    return [(float(i), 0.0) for i in range(n)]  # line


@pytest.mark.parametrize("kind", ["uniform", "hot spot", "copies", "line"])
@pytest.mark.parametrize("direct", [0, 1000])
def test_neighbours_equal_brute_force(spark, kind, direct):
    rng = random.Random(kind)
    sources = [(i, *p) for i, p in enumerate(layout(kind, rng, 240))]
    targets = [(i, *p) for i, p in enumerate(layout("uniform", rng, 60) + layout(kind, rng, 90) + [(9e6, -9e6)])]
    s = spark.createDataFrame(sources, "s int, x double, y double")
    t = spark.createDataFrame(targets, "t int, x double, y double")
    got = found(nb.nearest(t, s, ["t"], "s", 4, max_block=16, direct=direct))
    assert got == brute(targets, sources, 4)


def test_fewer_sources_than_k(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "s int, x double, y double")
    t = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 0.0)], "t int, x double, y double")
    for direct in (0, 10):
        got = found(nb.nearest(t, s, ["t"], "s", 4, direct=direct))
        assert got[1] == [(0, 1), (5, 2)] and len(got[2]) == 2
    assert nb.nearest(t, s.where("false"), ["t"], "s", 4).where("size(nn) > 0").count() == 0


def idw_case(spark):
    nn = spark.createDataFrame(
        [(1, [(1.0, 7), (2.0, 8)]), (2, [(50.0, 8), (60.0, 7)])], "t int, nn array<struct<dist:double,id:int>>")
    values = spark.createDataFrame(
        [(7, D0, 0, 10.0), (8, D0, 0, 20.0), (7, D0, 1, None), (8, D0, 1, 20.0), (9, D0, 2, 5.0)],
        "s int, prism_day date, ph int, v double")
    return nn, pack_hours(values, ["s", "prism_day"], ["v"])


@pytest.mark.parametrize("budget", [0, 2**28])
def test_idw(spark, budget):
    nn, packed = idw_case(spark)
    days = spark.createDataFrame([(D0,)], "prism_day date")
    out = {(r.t, r.ph): r.v for r in idw(nn, packed, ["t"], "s", ["v"], days, k=2, cutoff_m=10.0, budget=budget).collect()}
    assert len(out) == 48
    assert out[1, 0] == pytest.approx(13.3333, abs=1e-4) and out[1, 1] == 20 and out[1, 2] is None
    assert out[2, 0] is None  # nearest source beyond the cutoff
    free = {(r.t, r.ph): r.v for r in idw(nn, packed, ["t"], "s", ["v"], days, k=2, power=2.0, budget=budget).collect()}
    w = (1 / 50**2, 1 / 60**2)
    assert free[2, 0] == pytest.approx((20 * w[0] + 10 * w[1]) / sum(w))


def test_repeated_hour_is_an_error(spark):
    twice = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0)], "s int, ph int, v double")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        pack_hours(twice, ["s"], ["v"]).collect()


def test_anomalies_and_full_days(spark):
    data = [(1, D0, h, 10.0 + h if h != 3 else None, 5.0) for h in range(24)] + [(2, D0, h, 4.0, 5.0) for h in range(24)]
    df = spark.createDataFrame(data, "id int, prism_day date, ph int, v double, w double")
    out = day_anomalies(df, ["id"], "v")
    first = out.where("id = 1 and ph = 0").first()
    assert (first.frac, out.where("id = 1 and ph = 23").first().frac) == (0, 1) and first.amax - first.amin == pytest.approx(23)
    assert out.where("id = 2 and frac is not null").count() == 0
    assert [r.id for r in full_day_mean(df, ["id"], "v").collect()] == [2]


def template_rows(missing_td=None):
    return [(1, D1, h, float(h), 1.0 if h != missing_td else None) for h in range(24)]


def test_downscale(spark):
    schema = "g int, prism_day date, ph int, t double, td double"
    template = hourly_template(spark.createDataFrame(template_rows(), schema), ["g"], "t", "td")
    cells = spark.createDataFrame(
        [(1, 1, D1, 10.0, 20.0, 5.0), (2, 1, D1, 10.0, 10.0, 5.0), (3, 1, D1, 10.0, 20.0, None), (4, 9, D1, 1.0, 2.0, 1.0)],
        "cell int, g int, prism_day date, tmin double, tmax double, tdmean double")
    out = {(r.cell, r.ph): r for r in downscale(cells, template, ["cell"], ["g"]).collect()}
    assert {k[0] for k in out} == {1, 3} and len(out) == 48
    assert out[1, 0].t2m == 10 and out[1, 23].t2m == 20
    assert out[1, 5].ea == pytest.approx(6.1121 * math.exp((18.678 - 5 / 234.5) * (5 / 262.14)), rel=1e-9)
    assert out[3, 5].ea is None
    partial = hourly_template(spark.createDataFrame(template_rows(missing_td=4), schema), ["g"], "t", "td").first()
    assert partial.td_mean is None


def test_alignment(spark, rows):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "id int, a double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "id int, b double")
    assert rows(align_layers({"a": a, "b": b}, ["id"])) == [(2, None, 5.0)]
    assert align_layers({"a": a, "b": b}, ["id"], everywhere=False).count() == 3
    assert rows(align_to_sources(a.select("id"), b, ["id"], ["id"])) == [(1, None), (2, 5.0)]
    with pytest.raises(ValueError, match="duplicate"):
        align_to_sources(a, b.union(b), ["id"], ["id"])


def test_quality(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "id int, s string")
    assert rows(duplicate_keys(df, ["id"])) == [(1, 2)]
    with pytest.raises(ValueError):
        require_unique(df, ["id"])
    with pytest.raises(ValueError):
        require_covered(df, spark.createDataFrame([(1,)], "id int"), ["id"])
    assert rows(worst_groups(df, c("s") == "a", "id", 1)) == [(1, 1)]
    assert tuple(match_rate(df, spark.createDataFrame([(1,), (1,)], "id int"), ["id"]).first()) == (3, 2, pytest.approx(2 / 3))
    days = spark.createDataFrame([(D1,)], "prism_day date")
    have = spark.createDataFrame([("t", D1), ("n", D1)], "layer string, d date")
    assert rows(missing_inputs(days, have, ["n"], ["t"])) == [("t", D0)]
    assert days_to_run(days, days).count() == 0 and days_to_run(days, days, overwrite=True).count() == 1


def region_case(spark):
    cells = spark.createDataFrame(
        [(1, 0.0, D1, 0, 10.0, None), (2, 60.0, D1, 0, 40.0, 3.0), (3, 0.0, D1, 5, 7.0, None), (4, 0.0, D1, 1, 1.0, 1.0), (5, 0.0, D1, 1, None, None)],
        "cell int, lat double, prism_day date, ph int, a double, b double")
    mapping = spark.createDataFrame(
        [(1, 7, 100.0), (2, 7, 0.0), (3, 8, 5.0), (4, -1, 5.0), (5, 9, 5.0)], "cell int, tract_code int, pop double")
    codes = spark.createDataFrame([(7, "G7"), (8, "G8"), (9, "G9")], "tract_code int, GEOID string")
    return cells, mapping, codes


def test_region_table(spark):
    cells, mapping, codes = region_case(spark)
    points = spark.createDataFrame([("G7", 1.0, 2.0)], "GEOID string, lat double, lon double")
    out = {(r.GEOID, r.ph): r for r in tract_table(cells, mapping, codes, ["cell"], representative=points).collect()}
    assert {k[0] for k in out} == {"G7", "G8"} and len(out) == 48  # G9 is never covered, cell 4 is outside
    r = out["G7", 0]
    assert r.a_area == pytest.approx((10 * 1 + 40 * 0.5) / 1.5) and r.a_pop == 10  # no people on cell 2
    assert (r.b_area, r.b_pop) == (3, None) and r.lat == 1
    assert out["G7", 1].a_area is None and out["G8", 5].a_area == 7 and out["G8", 5].lat is None
    alone = tract_table(cells, mapping.drop("pop"), codes, ["cell"], population=False).where("GEOID = 'G7' and ph = 0").first()
    assert alone.a_area == pytest.approx(20) and alone.a_pop is None


def test_region_means_do_not_depend_on_partitioning(spark):
    rng = random.Random(5)
    # One region holds most of the rows.
    data = [(1 if rng.random() < 0.7 else rng.randrange(9), rng.gauss(20, 5), rng.random()) for _ in range(4000)]
    df = spark.createDataFrame(data, "tract_code int, v double, pop double")
    results = []
    for n in (1, 7):
        out = region_means(df.repartition(n), ["v"], ["tract_code"], F.lit(1.0), c("pop"))
        results.append({r.tract_code: (r.v_area, r.v_pop) for r in out.collect()})
    for key, (area, pop) in results[0].items():
        mine = [d for d in data if d[0] == key]
        assert min(d[1] for d in mine) <= area <= max(d[1] for d in mine)
        assert (area, pop) == (pytest.approx(results[1][key][0]), pytest.approx(results[1][key][1]))
        assert pop == pytest.approx(sum(d[1] * d[2] for d in mine) / sum(d[2] for d in mine))


def test_value_columns_and_population_check(spark):
    cells, mapping, _ = region_case(spark)
    assert value_columns(cells, ["cell"]) == ["a", "b"]
    with pytest.raises(ValueError):
        value_columns(cells.select("lat", "ph"))
    people = spark.createDataFrame([(1, 3.0)], "cell int, pop double")
    with pytest.raises(ValueError, match="population"):
        attach_population(mapping.drop("pop"), people, ["cell"])
    assert attach_population(mapping.drop("pop").where("cell = 1"), people, ["cell"]).first().pop == 3


def pairs(spark):
    return spark.createDataFrame(
        [("s1", D0, 1.0, 0.0), ("s1", D1, 1.0, 2.0), ("s2", D1, 5.0, 3.0), ("s2", D1, None, 3.0), ("s3", D1, None, 1.0)],
        "station_id string, prism_day date, temp_C_model double, temp_C_obs double")


def test_metrics(spark):
    suite = metrics_suite(pairs(spark), ["temp_C", "absent"], "m", "_model")
    r = suite["overall"].first()
    assert (r["var"], r.m_N) == ("temp_C", 3)
    assert (r.m_bias, r.m_mae, r.m_rmse) == (pytest.approx(2 / 3), pytest.approx(4 / 3), pytest.approx(math.sqrt(2)))
    stations = {x.station_id: x for x in suite["by_station"].collect()}
    assert stations["s3"].m_N == 0 and stations["s3"].m_bias is None and stations["s1"].m_bias == 0
    assert {x.prism_day: x.m_N for x in suite["by_day"].collect()} == {D0: 1, D1: 2}
    assert all_metrics(pairs(spark), ["temp_C"], "_model").groupBy("level").count().count() == 3
    with pytest.raises(ValueError):
        metrics_suite(pairs(spark), ["absent"], "m", "_model")


def test_paired(spark):
    df = spark.createDataFrame([(1.0, 3.0, 0.0), (-1.0, 3.0, 0.0)], "t_model double, t_era double, t_obs double")
    r = paired_metrics(df, ["t"], "model", "era").first()
    assert (r.paired_N, r.model_bias, r.model_rmse, r.era_rmse, r.rmse_era_minus_model) == (2, 0, 1, 3, 2)


def test_summary_rows(spark):
    stations = spark.createDataFrame([("s1", 100.0), ("s2", 300.0), ("s9", 1.0)], "station_id string, dist double")
    r = summary_rows(pairs(spark), stations, "dist", ["temp_C"], "_model").first()
    assert (r.n_stations, r.n_hours, r.dist_median_m, r.dist_p90_m) == (2, 3, 200, pytest.approx(280))


def linear_percentile(values, q):
    values = sorted(values)
    pos = q * (len(values) - 1)
    low = math.floor(pos)
    return values[low] + (pos - low) * (values[min(low + 1, len(values) - 1)] - values[low])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_percentiles(spark, values):
    # Repeats make one value hot.
    values = values + [values[0]] * (len(values) // 2)
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    r = exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p90": 0.9}).first()
    assert (r.p50, r.p90) == (pytest.approx(linear_percentile(values, 0.5)), pytest.approx(linear_percentile(values, 0.9)))


def test_stations(spark, rows):
    s = spark.createDataFrame([("a", 800.0, 9000.0, 1), ("b", 801.0, 10.0, 1), ("c", 1.0, 9001.0, 2)],
                              "station_id string, dist_m_model double, dist_m_era double, key int")
    assert [tuple(r)[4:] for r in keep_flags(s).collect()] == [(True, True, True), (False, True, False), (True, False, False)]
    layer = spark.createDataFrame([(1, 5.0), (3, 6.0)], "key int, v double")
    assert rows(on_stations(layer, s, ["key"]).select("station_id", "v")) == [("a", 5.0), ("b", 5.0)]
    obs = spark.createDataFrame([("a", 2, 9.0, 9.0), ("a", 1, 1.0, 2.0)], "station_id string, time_utc int, LAT double, LON double")
    assert rows(first_coordinates(obs)) == [("a", 1.0, 2.0)]


def test_spread_subset_covers_all_squares_first(spark):
    # One square holds most stations.
    data = [(f"x{i}", 1.0, 1.0) for i in range(200)] + [(f"y{i}", 10.0 * i, 40.0) for i in range(1, 5)]
    df = spark.createDataFrame(data, "station_id string, LAT double, LON double")
    picked = [r.station_id for r in spread_subset(df, 8).collect()]
    assert len(picked) == 8 and {f"y{i}" for i in range(1, 5)} <= set(picked)
    assert picked == [r.station_id for r in spread_subset(df.repartition(5), 8).collect()]
    assert spread_subset(df, 1000).count() == 204


def test_percentiles_with_an_outlier(spark):
    """One huge value must not gather a group's other values in one range."""
    from gridspark.operators import percentile

    seen = []
    original = percentile.materialise
    try:
        percentile.materialise = lambda df: seen.append(original(df)) or seen[-1]
        df = spark.range(20_000).select(F.lit(1).alias("g"), F.when(F.col("id") == 7, 1e12).otherwise(F.col("id") * 1.5).alias("v"))
        r = exact_percentiles(df, ["g"], "v", {"p50": 0.5, "max": 1.0}).first()
    finally:
        percentile.materialise = original
    ordered = sorted(1e12 if i == 7 else i * 1.5 for i in range(20_000))
    assert r["max"] == 1e12 and r.p50 == (ordered[9_999] + ordered[10_000]) / 2
    assert seen[0].groupBy("part").count().agg({"count": "max"}).first()[0] <= 20_000


def test_axis_lines_crowded_in_a_corner(spark):
    """99 % of the lines share 1 % of the range: no bucket holds more than a few gaps, and the nearest lines stay right."""
    import bisect
    import random

    rng = random.Random(7)
    lines = sorted({rng.uniform(0, 1) for _ in range(3_960)} | {rng.uniform(1, 100) for _ in range(40)})
    values = [rng.uniform(-1, 1.1) for _ in range(600)] + [rng.uniform(-5, 120) for _ in range(200)] + lines[::97]
    grid = spark.createDataFrame([(x,) for x in lines], "g double")
    got = axis_nearest(spark.createDataFrame([(x,) for x in values], "v double"), grid, "v", "g", "near").collect()
    assert len(got) == len(values)
    for r in got:
        k = bisect.bisect_left(lines, r.v)
        assert abs(r.near - r.v) == min(abs(x - r.v) for x in lines[max(0, k - 1):k + 1])
    borders = [lines[n] for n in range(0, len(lines), 8)]
    sizes = with_bucket(grid, c("g"), borders, "b").groupBy("b").count().agg(F.max("count")).first()[0]
    assert sizes == 8


def test_bucketed_layers_join_without_an_exchange(spark, tmp_path):
    keys = ["cell", "day"]
    layers = {}
    for n, name in enumerate(("a", "b", "d")):
        df = spark.range(n, 60).select(c("id").alias("cell"), (c("id") % 3).alias("day"), (c("id") * 1.0).alias(name))
        write_bucketed(df, f"bucketed_{name}", keys, 4, str(tmp_path / name))
        layers[name] = spark.table(f"bucketed_{name}")
    joined = join_layers(layers, keys)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(r.cell for r in joined.collect()) == list(range(2, 60))
    assert all(r.a == r.b == r.d == r.cell for r in joined.collect())


def test_counts_come_with_the_job_itself(spark, tmp_path):
    rows = spark.range(100).select((c("id") % 10).alias("k"))
    matched, counts = match_counts(rows, spark.createDataFrame([(1,), (1,), (4,), (99,)], "k long"), ["k"])
    matched.write.parquet(str(tmp_path / "out"))
    assert counts.get == {"rows_seen": 100, "rows_matched": 20}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
