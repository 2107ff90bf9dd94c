import math
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.functions import geo, heat, humidity, missing, time, wbgt
from gridspark.functions.utci import COEFFICIENTS, exponents, utci_c

c = F.col


def one(spark, column, **values):
    """Value of a column over one row of doubles (or the given types)."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'double' if isinstance(v, (float, int, type(None))) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("r")).first().r


def test_missing_rules(spark):
    x = c("x")
    assert one(spark, missing.finite(x), x=float("nan")) is None
    assert one(spark, missing.finite(x), x=float("-inf")) is None
    assert one(spark, missing.finite(x), x=-3.5) == -3.5
    assert one(spark, missing.sentinel_to_null(x, -9999), x=-9999.0) is None
    assert one(spark, missing.clip(x, 0, 1), x=None) is None
    assert [one(spark, missing.clip(x, 0, 1), x=v) for v in (-1.0, 0.5, 7.0)] == [0, 0.5, 1]


@pytest.mark.parametrize("t, expected", [(0, 6.1121), (20, 23.3834), (-10, 2.5995)])
def test_saturation(spark, t, expected):
    assert one(spark, humidity.saturation_hpa(c("t")), t=float(t)) == pytest.approx(expected, abs=1e-4)


def test_humidity(spark):
    assert one(spark, humidity.relative_humidity(c("e"), c("t")), e=10.0, t=20.0) == pytest.approx(42.7654, abs=1e-3)
    assert one(spark, humidity.relative_humidity(c("e"), c("t")), e=99.0, t=20.0) == 100
    assert one(spark, humidity.relative_humidity(c("e"), c("t")), e=None, t=20.0) is None
    assert one(spark, humidity.vapor_pressure(c("r"), c("t")), r=50.0, t=20.0) == pytest.approx(23.3834 / 2, abs=1e-3)


def test_shifted_vapor_pressure_stays_in_bounds(spark):
    ea = humidity.shifted_vapor_pressure(c("td"), c("m"), c("d"), c("t"))
    # Dewpoint above the air temperature is limited to saturation, a very low one to the floor.
    assert one(spark, ea, td=30.0, m=10.0, d=12.0, t=20.0) == pytest.approx(23.3834, abs=1e-3)
    assert one(spark, ea, td=-80.0, m=0.0, d=0.0, t=20.0) == pytest.approx(0.05)
    assert one(spark, ea, td=5.0, m=0.0, d=0.0, t=None) is None
    cold = one(spark, ea, td=-90.0, m=0.0, d=0.0, t=-60.0)
    assert cold == pytest.approx(one(spark, humidity.saturation_hpa(c("t")), t=-60.0))


@pytest.mark.parametrize("t_f, rh, expected", [(90, 70, 105.92), (100, 40, 109.26), (70, 50, 69.05), (30, 50, 30.0)])
def test_heat_index(spark, t_f, rh, expected):
    assert one(spark, heat.heat_index_f(c("t"), c("r")), t=float(t_f), r=float(rh)) == pytest.approx(expected, abs=0.01)


def test_heat_index_adjustments(spark):
    dry = one(spark, heat.heat_index_f(c("t"), c("r")), t=95.0, r=5.0)
    humid = one(spark, heat.heat_index_f(c("t"), c("r")), t=82.0, r=95.0)
    raw = lambda t, r: (-42.379 + 2.04901523 * t + 10.14333127 * r - .22475541 * t * r - 6.83783e-3 * t * t
                        - 5.481717e-2 * r * r + 1.22874e-3 * t * t * r + 8.5282e-4 * t * r * r - 1.99e-6 * t * t * r * r)
    assert dry == pytest.approx(raw(95, 5) - 2.0)
    assert humid == pytest.approx(raw(82, 95) + 0.02 * 10 * 5)
    assert one(spark, heat.heat_index_f(c("t"), c("r")), t=None, r=5.0) is None


def test_direct_fraction_of_weak_or_missing_radiation(spark):
    f = heat.direct_fraction(c("g"), c("d"))
    assert one(spark, f, g=100.0, d=30.0) == pytest.approx(0.7)
    assert one(spark, f, g=0.5, d=30.0) == 0
    assert one(spark, f, g=1.0, d=0.0) == 0
    assert one(spark, f, g=None, d=1.0) == 0
    assert one(spark, f, g=0.0, d=0.0) == 0


def test_cosine_and_shortwave(spark):
    assert one(spark, heat.cos_zenith_daytime(c("s")), s=100.0) == -0.5
    assert one(spark, heat.cos_zenith_daytime(c("s")), s=60.0) == pytest.approx(0.5)
    terms = heat.shortwave_terms(c("g"), c("n"), c("a"), c("s"))
    got = {k: one(spark, v, g=-1.0, n=200.0, a=None, s=60.0) for k, v in terms.items()}
    assert got == pytest.approx({"ssrd": 0, "ssr": 0, "dsrp": 200, "fdir": 100, "cossza": 0.5})


def test_mean_radiant_night_equals_black_body(spark):
    flux = 5.67e-8 * 290.0**4
    k = heat.mean_radiant_k(*[c(n) for n in ("ssrd", "ssr", "dsrp", "strd", "fdir", "strr", "cz")])
    assert one(spark, k, ssrd=0.0, ssr=0.0, dsrp=0.0, strd=flux, fdir=0.0, strr=0.0, cz=0.0) == pytest.approx(290.0)


# Published check values of the index: air, radiant, wind, humidity (%) -> index.
@pytest.mark.parametrize("ta, tr, va, rh, expected", [
    (25, 25, 1, 50, 24.6), (25, 27, 1, 50, 25.2), (19, 24, 1, 50, 20.0), (19, 14, 1, 50, 16.8),
    (27, 22, 10, 50, 20.0), (27, 22, 16, 50, 15.8)])
def test_utci(spark, ta, tr, va, rh, expected):
    es = 6.1121 * math.exp((18.678 - ta / 234.5) * (ta / (257.14 + ta)))
    got = one(spark, utci_c("ta", "va", "tr", "e"), ta=float(ta), va=float(va), tr=float(tr), e=es * rh / 100)
    assert got == pytest.approx(expected, abs=0.06)


def test_utci_nested_form_equals_plain_sum(spark):
    ta, va, tr, e = -12.0, 7.5, 21.0, 1.9
    plain = ta + sum(k * (e / 10) ** p * (tr - ta) ** d * va**v * ta**t for k, (p, d, v, t) in zip(COEFFICIENTS, exponents()))
    assert one(spark, utci_c("ta", "va", "tr", "e"), ta=ta, va=va, tr=tr, e=e) == pytest.approx(plain)
    assert one(spark, utci_c("ta", "va", "tr", "e"), ta=ta, va=va, tr=None, e=e) is None


def test_utci_mask_edges(spark):
    mask = heat.utci_in_range(c("t"), c("w"), c("r"), c("e"), c("m"), c("u"))
    good = dict(t=20.0, w=2.0, r=50.0, e=10.0, m=30.0, u=21.0)
    assert one(spark, mask, **good) == 21.0
    for change in (dict(r=5.0), dict(r=None), dict(e=50.0), dict(e=None), dict(w=0.4), dict(w=17.1), dict(t=51.0, m=60.0),
                   dict(m=91.0), dict(m=-11.0), dict(u=None)):
        assert one(spark, mask, **{**good, **change}) is None
    assert one(spark, mask, **{**good, "r": 100.0}) == 21.0


def bisect(f, low, high):
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return (low + high) / 2


@pytest.mark.parametrize("t, rh, p, u, s, f, cz", [
    (300.0, 50.0, 101325.0, 2.0, 800.0, 0.7, 0.8), (313.0, 20.0, 99000.0, 0.13, 1000.0, 0.8, 0.95),
    (275.0, 90.0, 85000.0, 6.0, 0.0, 0.0, 1.0)])
def test_wbgt_balances_agree_with_bisection(t, rh, p, u, s, f, cz):
    globe, wick, _ = (float(x[0]) for x in wbgt.energy_balance(*[np.array([v]) for v in (t, rh, p, u, s, f, cz)]))
    sigma, hpa = wbgt.SIGMA, p / 100
    visc = lambda x: float(wbgt._viscosity(x))
    esat = lambda x: float(wbgt._saturation(x))
    ea = rh / 100 * esat(t)
    lw = 0.5 * (0.575 * ea**0.143 + 0.999) * t**4

    def conduct(film, d):
        return visc(film) * (wbgt.CP + 1.25 * wbgt.R_AIR) / d

    def reynolds(film, d):
        return u * hpa * 100 / (wbgt.R_AIR * film) * d / visc(film)

    def globe_balance(x):
        film = (x + t) / 2
        h = (2 + 0.6 * math.sqrt(reynolds(film, 0.0508)) * wbgt.PRANDTL**0.3333) * conduct(film, 0.0508)
        return lw + s / (2 * sigma * 0.95) * 0.95 * (f * (1 / (2 * cz) - 1) + 1.45) - x**4 - h / (sigma * 0.95) * (x - t)

    def wick_balance(x):
        film = (x + t) / 2
        h = 0.281 * reynolds(film, 0.007) ** 0.6 * wbgt.PRANDTL**0.44 * conduct(film, 0.007)
        dif = wbgt.DIFFUSIVITY_TIMES_P / hpa * (film / wbgt.DIFFUSIVITY_REF_K) ** 2.334
        schmidt = visc(film) / (hpa * 100 / (wbgt.R_AIR * film) * dif)
        latent = ((313.15 - film) / 30 * -71100 + 2.4073e6) / wbgt.PSYCHROMETRIC * (wbgt.PRANDTL / schmidt) ** 0.56
        edge = 0.25 * 0.007 / 0.0254
        sun = s * 0.6 * ((1 - f) * (1 + edge) + f * (math.tan(math.acos(cz)) / math.pi + edge) + 0.45)
        return t - x - latent * (esat(x) - ea) / (hpa - esat(x)) + (sigma * 0.95 * (lw - x**4) + sun) / h

    assert globe == pytest.approx(bisect(globe_balance, 200, 450), abs=1e-5)
    assert wick == pytest.approx(bisect(wick_balance, 200, 370), abs=1e-5)


def test_wbgt_settles_every_row(monkeypatch):
    """Rows that the steps leave open are settled by halving, to the same roots."""
    rng = np.random.default_rng(5)
    n = 20_000
    args = (rng.uniform(230, 330, n), rng.uniform(0, 100, n), rng.uniform(6e4, 1.05e5, n), rng.uniform(0.13, 30, n),
            rng.uniform(0, 1200, n), rng.uniform(0, 1, n), rng.uniform(0.01, 1, n))
    globe, wick, _ = wbgt.energy_balance(*args)
    assert np.isfinite(globe).all() and np.isfinite(wick).all()
    monkeypatch.setattr(wbgt, "NEWTON_STEPS", 1)
    globe_2, wick_2, _ = wbgt.energy_balance(*args)
    settled = np.abs(globe - globe_2) < 2e-3
    assert settled.mean() > 0.999 and (np.abs(wick - wick_2) < 2e-3).mean() > 0.999


def test_wbgt_looks_for_no_root_where_there_is_no_result(monkeypatch):
    """A beam from the horizon leaves the globe without a temperature; such rows, and rows that lack an input, cost no halvings
    and no steps of the wet bulb, and the others keep their values."""
    n = 1000
    full = [np.full(n, v) for v in (300.0, 50.0, 101325.0, 2.0, 800.0, 0.7, 0.8)]
    expected = float(wbgt._solve.func(*[pd.Series(a[:1]) for a in full])[0])
    args = [a.copy() for a in full]
    args[6][::2] = 6e-17
    args[4][1::10] = np.nan
    seen = []
    settle = wbgt._settle
    monkeypatch.setattr(wbgt, "_settle", lambda balance, t, *rest: seen.append(len(t)) or settle(
        lambda x, *a: seen.append(-len(x)) or balance(x, *a), t, *rest))
    found = wbgt._solve.func(*[pd.Series(a) for a in args]).to_numpy()
    kept = np.isfinite(args[4]) & (args[6] == 0.8)
    assert kept.sum() == 400 and (found[kept] == expected).all() and np.isnan(found[~kept]).all()
    # Globe: 900 rows with all inputs, and 500 of them at the two ends of the bracket; wet bulb: 400.
    assert [k for k in seen if k > 0] == [900, 400]
    assert [k for k in seen if k < 0] == [-900] * wbgt.NEWTON_STEPS + [-500] * 2 + [-400] * wbgt.NEWTON_STEPS


def test_wbgt_column(spark):
    k = wbgt.wbgt_k(*[c(n) for n in ("t", "r", "p", "w", "g", "f", "z")])
    day = dict(t=300.0, r=50.0, p=101325.0, w=2.0, g=800.0, f=0.7, z=0.8)
    assert one(spark, k, **day) - 273.15 == pytest.approx(26.48, abs=0.05)
    assert one(spark, k, **{**day, "g": None}) is None
    night = one(spark, k, **{**day, "g": 0.0, "z": -0.5})
    assert night < one(spark, k, **day)


def test_albers_published_example(spark):
    # Clarke 1866 example of Snyder (1987): 35 N, 75 W.
    x, y = geo.albers_xy(c("lat"), c("lon"), semi_major=6378206.4, eccentricity_sq=0.00676866)
    assert one(spark, x, lat=35.0, lon=-75.0) == pytest.approx(1885472.7, abs=0.1)
    assert one(spark, y, lat=35.0, lon=-75.0) == pytest.approx(1535925.0, abs=0.1)
    x, y = geo.albers_xy(c("lat"), c("lon"))
    assert one(spark, x, lat=23.0, lon=-96.0) == pytest.approx(0, abs=1e-6)
    assert one(spark, y, lat=23.0, lon=-96.0) == pytest.approx(0, abs=1e-6)


def test_keys_and_boxes(spark):
    assert one(spark, geo.packed_key(c("a"), c("b")), a=40.123456, b=-100.654321) == 40123456 * 10**9 - 100654321
    assert one(spark, geo.packed_key(c("a"), c("b"), 4), a=40.12345, b=-100.0) == 401234 * 10**9 - 1000000  # half to even
    assert one(spark, geo.round_coordinate(c("a"), 2), a=1.005) == pytest.approx(1.0)
    assert one(spark, geo.in_conus(c("a"), c("b")), a=24.0, b=-125.0) is True
    assert one(spark, geo.in_conus(c("a"), c("b")), a=50.51, b=-100.0) is False
    assert one(spark, geo.area_weight(c("a")), a=60.0) == pytest.approx(0.5)
    assert one(spark, geo.area_weight(c("a")), a=95.0) == 0
    assert one(spark, geo.cell_center(c("a"), 50.0, -0.5), a=0.0) == 49.75
    assert one(spark, geo.inverse_distance_weight(c("a")), a=0.0) == pytest.approx(1e6)
    assert one(spark, geo.inverse_distance_weight(c("a"), 2.0), a=4.0) == pytest.approx(1 / 16)


def test_time(spark):
    df = spark.sql("select timestamp_ntz'2010-07-15 12:00:00' as noon, timestamp_ntz'2010-07-15 11:59:00' as before")
    r = df.select(
        time.shifted_day(c("noon")), time.shifted_hour(c("noon")), time.shifted_day(c("before")), time.shifted_hour(c("before")),
        time.in_day_range(c("noon"), F.lit("2010-07-14").cast("date"), F.lit("2010-07-15").cast("date")),
        time.in_day_range(c("before"), F.lit("2010-07-14").cast("date"), F.lit("2010-07-15").cast("date"))).first()
    assert tuple(r) == (date(2010, 7, 16), 0, date(2010, 7, 15), 23, False, True)
    stamps = spark.sql("select date'2010-01-01' as d").select(time.day_timestamps(c("d")).alias("s")).first().s
    assert stamps[0] == datetime(2009, 12, 31, 12) and stamps[-1] == datetime(2010, 1, 1, 11) and len(stamps) == 24


def test_time_columns_cross_the_year(spark):
    df = spark.sql("select date'2010-01-01' as d, 0 as ph")
    utc = df.select(*[x.alias(n) for n, x in time.time_columns(c("d"), c("ph"), "utc").items()]).first()
    label = df.select(*[x.alias(n) for n, x in time.time_columns(c("d"), c("ph"), "prism").items()]).first()
    assert tuple(utc) == (2009, 12, 31, 12) and tuple(label) == (2010, 1, 1, 0)
    with pytest.raises(ValueError):
        time.time_columns(c("d"), c("ph"), "local")


def test_labels(spark):
    df = spark.sql("select date'2010-07-15' as a, date'2010-07-21' as b, date'2010-08-02' as e")
    r = df.select(time.window_label(c("a"), c("b")), time.window_label(c("a"), c("e")), time.window_tag(c("a"), c("a")),
                  time.window_tag(c("a"), c("b"))).first()
    assert tuple(r) == ("2010 Jul 15–21 (JJA)", "2010 Jul 15–Aug 02 (JJA)", "2010-07-15", "2010-07-15_to_2010-07-21")
    months = spark.sql("select explode(array(12, 3, 8, 11)) as m").select(time.season(F.make_date(F.lit(2010), c("m"), F.lit(1))).alias("s"))
    assert [r.s for r in months.collect()] == ["DJF", "MAM", "JJA", "SON"]


def test_day_of_year(spark):
    df = spark.range(1)
    assert df.select(time.day_from_doy(F.lit(2012), F.lit(366)).alias("d")).first().d == date(2012, 12, 31)
    with pytest.raises(Exception, match="outside the year"):
        df.select(time.day_from_doy(F.lit(2011), F.lit(366)).alias("d")).collect()


def test_bad_timestamps_are_null(spark):
    assert one(spark, time.stamp_from_text(c("s")), s="2010070125") is None
    assert one(spark, time.stamp_from_text(c("s")), s="abc") is None
    assert one(spark, time.stamp_from_text(c("s")), s=" 2010070123 ") == datetime(2010, 7, 1, 23)
