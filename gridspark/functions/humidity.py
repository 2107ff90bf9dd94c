"""Vapour pressure and relative humidity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.missing import at_most, clip

KELVIN = 273.15

# Saturation pressure over water (t >= 0) and over ice, in hPa and degrees C.
WATER = {"scale": 6.1121, "slope": 18.678, "bend": 234.5, "offset": 257.14}
ICE = {"scale": 6.1115, "slope": 23.036, "bend": 333.7, "offset": 279.82}


def kelvin_to_celsius(value: Column) -> Column:
    return value - F.lit(KELVIN)


def saturation_hpa(t_c: Column) -> Column:
    """Saturation vapour pressure in hPa at `t_c` degrees C."""

    def branch(k: dict[str, float]) -> Column:
        return F.lit(k["scale"]) * F.exp(
            (F.lit(k["slope"]) - t_c / F.lit(k["bend"])) * (t_c / (F.lit(k["offset"]) + t_c))
        )

    return F.when(t_c >= 0, branch(WATER)).when(t_c < 0, branch(ICE))


def relative_humidity(ea_hpa: Column, t_c: Column) -> Column:
    """Relative humidity in percent, limited to 0..100."""
    share = F.lit(100.0) * ea_hpa / F.greatest(saturation_hpa(t_c), F.lit(1e-6))
    return F.when(t_c.isNotNull(), clip(share, 0.0, 100.0))


def vapor_pressure(rh_pct: Column, t_c: Column) -> Column:
    """Vapour pressure in hPa from relative humidity."""
    return rh_pct / F.lit(100.0) * saturation_hpa(t_c)


def shifted_vapor_pressure(
    td_hour: Column, td_template_mean: Column, td_day_mean: Column, t_c: Column, floor_hpa: float = 0.05
) -> Column:
    """Hourly vapour pressure from a dewpoint curve moved to the day's own mean.

    The result lies between a small floor and saturation at the air temperature.
    """
    limit = saturation_hpa(t_c)
    raw = saturation_hpa(td_hour + (td_day_mean - td_template_mean))
    return F.when(limit.isNotNull(), clip(raw, at_most(limit, floor_hpa), limit))
