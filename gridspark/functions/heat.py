"""Wind, radiation terms, heat index, mean radiant temperature and validity masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.humidity import KELVIN
from gridspark.functions.missing import clip, keep_between

STEFAN_BOLTZMANN = 5.67e-8

# Physical range of a wet-bulb globe temperature, degrees C.
WBGT_RANGE = (-60.0, 80.0)

# Range in which the thermal-climate index is defined.
UTCI_AIR_C = (-50.0, 50.0)
UTCI_RADIANT_EXCESS_C = (-30.0, 70.0)
UTCI_WIND_MS = (0.5, 17.0)
UTCI_RH_ABOVE_PCT, UTCI_RH_MAX_PCT = 5.0, 100.0
UTCI_VAPOR_BELOW_HPA = 50.0

# Stand-ins for missing index inputs; the result is masked afterwards.
UTCI_DEFAULTS = {"t_k": 273.15, "wind": 1.0, "ea_hpa": 10.0, "albedo": 0.2, "sza_deg": 180.0}


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def heat_index_f(t_f: Column, rh_pct: Column) -> Column:
    """Heat index in degF: simple form when it stays below 79, else the NWS regression.

    The two humidity corrections apply by temperature and humidity alone.
    """
    t, r = t_f, rh_pct
    simple = F.lit(-10.3) + F.lit(1.1) * t + F.lit(0.047) * r
    t2, r2 = t * t, r * r
    regression = (
        F.lit(-42.379)
        + F.lit(2.04901523) * t
        + F.lit(10.14333127) * r
        - F.lit(0.22475541) * t * r
        - F.lit(6.83783e-3) * t2
        - F.lit(5.481717e-2) * r2
        + F.lit(1.22874e-3) * t2 * r
        + F.lit(8.5282e-4) * t * r2
        - F.lit(1.99e-6) * t2 * r2
    )
    base = F.when(t.isNull() | r.isNull(), F.lit(None)).when(t <= 40, t).when(simple < 79, simple)
    dry = (F.lit(13.0) - r) / 4 * F.sqrt((F.lit(17.0) - F.abs(t - 95)) / 17)
    humid = F.lit(0.02) * (r - 85) * (F.lit(87.0) - t)
    return (
        base.otherwise(regression)
        - F.when((r <= 13) & t.between(80, 112), dry).otherwise(F.lit(0.0))
        + F.when((r > 85) & t.between(80, 87), humid).otherwise(F.lit(0.0))
    )


def heat_index_c(t_c: Column, rh_pct: Column) -> Column:
    """Heat index in degrees C, defined for every temperature (no masking of the mild range)."""
    return (heat_index_f(t_c * F.lit(1.8) + 32, rh_pct) - 32) / F.lit(1.8)


def cos_zenith(sza_deg: Column) -> Column:
    return F.cos(F.radians(sza_deg))


def cos_zenith_daytime(sza_deg: Column) -> Column:
    """Cosine of the zenith angle; -0.5 marks a sun at or below the horizon."""
    c = cos_zenith(sza_deg)
    return F.when(c <= 0, F.lit(-0.5)).otherwise(c)


def direct_fraction(ghi: Column, dhi: Column) -> Column:
    """Direct share of global radiation; 0 when global radiation is at most 1 W/m2 or missing."""
    share = F.lit(1.0) - F.try_divide(dhi, ghi)
    return F.when(ghi > 1, clip(share, 0.0, 1.0)).otherwise(F.lit(0.0))


def shortwave_terms(ghi: Column, dni: Column, albedo: Column, sza_deg: Column) -> dict[str, Column]:
    """Global, net, direct-normal and direct-horizontal shortwave, plus the cosine used for them."""
    positive = lambda c: F.when(c > 0, c).otherwise(F.lit(0.0))
    surface = clip(F.coalesce(albedo, F.lit(UTCI_DEFAULTS["albedo"])), 0.0, 1.0)
    cosine = positive(cos_zenith(F.coalesce(sza_deg, F.lit(UTCI_DEFAULTS["sza_deg"]))))
    down, normal = positive(ghi), positive(dni)
    return {
        "ssrd": down,
        "ssr": (F.lit(1.0) - surface) * down,
        "dsrp": normal,
        "fdir": normal * cosine,
        "cossza": cosine,
    }


def mean_radiant_k(
    ssrd: Column, ssr: Column, dsrp: Column, strd: Column, fdir: Column, strr: Column, cossza: Column
) -> Column:
    """Mean radiant temperature in K from seven flux terms (Di Napoli et al. 2020)."""
    elevation = F.degrees(F.asin(cossza))
    projected = F.lit(0.308) * F.cos(
        F.radians(elevation * (F.lit(0.998) - elevation * elevation / F.lit(50000.0)))
    )
    longwave = F.lit(0.5) * strd + F.lit(0.5) * (strd - strr)
    shortwave = F.lit(0.5) * (ssrd - fdir) + F.lit(0.5) * (ssrd - ssr) + projected * dsrp
    flux = longwave + F.lit(0.7 / 0.97) * shortwave
    return F.when(flux >= 0, F.sqrt(F.sqrt(flux / F.lit(STEFAN_BOLTZMANN))))


def wbgt_in_range(wbgt_c: Column) -> Column:
    return keep_between(wbgt_c, *WBGT_RANGE)


def utci_in_range(
    t_c: Column, wind: Column, rh_pct: Column, ea_hpa: Column, radiant_c: Column, utci_c: Column
) -> Column:
    """Keep the index where its inputs are in the valid range.

    Missing humidity, vapour pressure or index counts as invalid.
    """
    inside = lambda c, bounds: F.coalesce(c.between(*bounds), F.lit(True))
    return F.when(
        inside(t_c, UTCI_AIR_C)
        & inside(radiant_c - t_c, UTCI_RADIANT_EXCESS_C)
        & inside(wind, UTCI_WIND_MS)
        & (rh_pct > UTCI_RH_ABOVE_PCT)
        & (rh_pct <= UTCI_RH_MAX_PCT)
        & (ea_hpa < UTCI_VAPOR_BELOW_HPA),
        utci_c,
    )


def all_present(*inputs: Column) -> Column:
    result = F.lit(True)
    for column in inputs:
        result = result & column.isNotNull()
    return result


def kelvin(t_c: Column) -> Column:
    return t_c + F.lit(KELVIN)
