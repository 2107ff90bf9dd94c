"""Outdoor wet-bulb globe temperature (Liljegren et al. 2008).

Wind reduction and the choice of stability class are Column expressions. The two energy
balances (black globe, wet wick) have no closed form; they are solved by a fixed number of
Newton steps over whole Arrow batches. Rows whose last step still moved more than the tolerance
are settled by bisection, whose bracket and number of halvings are fixed too, so every batch finishes.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The solver travels with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Physical constants and sensor geometry of the published model (SI, pressure hPa).
SIGMA = 5.6696e-8
CP = 1003.5
M_AIR = 28.97
M_H2O = 18.015
R_AIR = 8314.34 / M_AIR
PRANDTL = CP / (CP + 1.25 * R_AIR)
PSYCHROMETRIC = CP * M_AIR / M_H2O
EMIS_WICK, ALB_WICK, D_WICK, L_WICK = 0.95, 0.4, 0.007, 0.0254
EMIS_GLOBE, ALB_GLOBE, D_GLOBE = 0.95, 0.05, 0.0508
EMIS_SURFACE, ALB_SURFACE = 0.999, 0.45
MIN_SPEED = 0.13
# Rural wind-profile exponents by stability class 1..6.
WIND_EXPONENT = (0.07, 0.07, 0.10, 0.15, 0.35, 0.55)
# Diffusivity of vapour in air times pressure, at the reference temperature below.
DIFFUSIVITY_REF_K = math.sqrt(132.0 * 647.3)
DIFFUSIVITY_TIMES_P = (
    3.640e-4 * (36.4 * 218.0) ** (1 / 3) * (132.0 * 647.3) ** (5 / 12)
    * math.sqrt(1 / M_AIR + 1 / M_H2O) * 1013.25 * 1e-4
)

NEWTON_STEPS = 9
TOLERANCE_K = 1e-3
# Bisection: reach below and above the air temperature, and halvings, which leave under a millionth of a kelvin.
BRACKET_K = (120.0, 400.0)
HALVINGS = 50


def wind_at_2m(speed_10m: Column, ghi: Column, cos_zenith: Column) -> Column:
    """Wind at 2 m from 10 m by the rural power profile, at least 0.13 m/s."""
    klass = _stability_class(speed_10m, ghi, cos_zenith > 0)
    exponent = F.when(klass == 1, F.lit(WIND_EXPONENT[0]))
    for number, value in enumerate(WIND_EXPONENT[1:], start=2):
        exponent = exponent.when(klass == number, F.lit(value))
    reduced = speed_10m * F.pow(F.lit(0.2), exponent)
    return F.when(reduced < MIN_SPEED, F.lit(MIN_SPEED)).otherwise(reduced)


def _stability_class(speed: Column, ghi: Column, daytime: Column) -> Column:
    """Stability class from wind and insolation by day, from wind alone by night."""

    def by_speed(bounds: tuple[float, ...], classes: tuple[int, ...]) -> Column:
        chain = F.when(speed < bounds[0], F.lit(classes[0]))
        for bound, value in zip(bounds[1:], classes[1:]):
            chain = chain.when(speed < bound, F.lit(value))
        return chain.otherwise(F.lit(classes[-1]))

    # Wind limits (m/s), insolation limits (W/m2) and the classes between them.
    day_wind = (2.0, 3.0, 5.0, 6.0)
    return (
        F.when(~daytime, by_speed((2.0, 2.5), (5, 5, 4)))
        .when(ghi >= 925, by_speed(day_wind, (1, 1, 2, 3, 3)))
        .when(ghi >= 675, by_speed(day_wind, (1, 2, 2, 3, 4)))
        .when(ghi >= 175, by_speed(day_wind, (2, 3, 3, 4, 4)))
        .otherwise(F.lit(4))
    )


def wbgt_k(
    t_k: Column, rh_pct: Column, pressure_pa: Column, wind_10m: Column,
    ghi: Column, direct_share: Column, cos_zenith: Column,
) -> Column:
    """Wet-bulb globe temperature in K; NULL when an input is NULL or the balances have no root near the air's."""
    return _solve(
        t_k.cast("double"),
        rh_pct.cast("double"),
        pressure_pa.cast("double"),
        wind_at_2m(wind_10m, ghi, cos_zenith).cast("double"),
        ghi.cast("double"),
        # No direct beam from a sun at or below the horizon.
        F.when(cos_zenith > 0, direct_share).otherwise(F.lit(0.0)).cast("double"),
        F.when(cos_zenith > 0, cos_zenith).otherwise(F.lit(1.0)).cast("double"),
    )


@F.pandas_udf(DoubleType())
def _solve(
    t: pd.Series, rh: pd.Series, p: pd.Series, u: pd.Series, s: pd.Series, f: pd.Series, cz: pd.Series
) -> pd.Series:
    args = [x.to_numpy(np.float64) for x in (t, rh, p, u, s, f, cz)]
    out = np.full(len(t), np.nan)
    full = np.flatnonzero(np.all([np.isfinite(a) for a in args], axis=0))
    globe, wick, air = energy_balance(*[a[full] for a in args])
    result = 0.1 * air + 0.2 * globe + 0.7 * wick
    out[full] = np.where(np.isfinite(result), result, np.nan)
    return pd.Series(out)


def energy_balance(t, rh, p, u, s, f, cz):
    """(globe, natural wet bulb, air) temperatures in K of one batch of arrays.

    A row without a globe temperature has no result, so its wet bulb is not looked for and is NaN too.
    """
    with np.errstate(all="ignore"):
        p = p / 100.0
        ea = rh / 100.0 * _saturation(t)
        longwave = 0.5 * (0.575 * ea**0.143 + EMIS_SURFACE) * t**4
        globe = _globe(t, p, u, s, f, cz, longwave)
        wick, at = np.full(len(t), np.nan), np.flatnonzero(np.isfinite(globe))
        wick[at] = _wick(*[a[at] for a in (t, p, u, s, f, cz, longwave, ea)])
    return globe, wick, t


def _globe(t, p, u, s, f, cz, longwave):
    shortwave = s / (2 * SIGMA * EMIS_GLOBE) * (1 - ALB_GLOBE) * (f * (0.5 / cz - 1) + 1 + ALB_SURFACE)

    def balance(x, t, p, u, gain):
        film = 0.5 * (x + t)
        mu = _viscosity(film)
        reynolds = u * p * (100 / R_AIR * D_GLOBE) / (film * mu)
        h = (2 + 0.6 * PRANDTL**0.3333 * np.sqrt(reynolds)) * mu * ((CP + 1.25 * R_AIR) / D_GLOBE)
        h /= SIGMA * EMIS_GLOBE
        return gain - x**4 - h * (x - t), 4 * x**3 + h

    return _settle(balance, t, p, u, longwave + shortwave)


def _wick(t, p, u, s, f, cz, longwave, ea):
    edge = 0.25 * D_WICK / L_WICK
    beam = np.sqrt(1 - cz * cz) / cz / math.pi + edge
    shortwave = s * (1 - ALB_WICK) * ((1 - f) * (1 + edge) + f * beam + ALB_SURFACE)

    def balance(x, t, p, u, longwave, shortwave, ea):
        film = 0.5 * (x + t)
        mu = _viscosity(film)
        reynolds = u * p * (100 / R_AIR * D_WICK) / (film * mu)
        h = 0.281 * PRANDTL**0.44 * reynolds**0.6 * mu * ((CP + 1.25 * R_AIR) / D_WICK)
        schmidt = mu * R_AIR * film / (100 * DIFFUSIVITY_TIMES_P * (film / DIFFUSIVITY_REF_K) ** 2.334)
        evaporation = (313.15 - film) / 30 * -71100.0 + 2.4073e6
        latent = evaporation / PSYCHROMETRIC * (PRANDTL / schmidt) ** 0.56
        ew = _saturation(x)
        radiant = SIGMA * EMIS_WICK * (longwave - x**4) + shortwave
        curve = ew * 17.502 * (273.15 - 32.18) / (x - 32.18) ** 2
        slope = 1 + latent * curve * (p - ea) / (p - ew) ** 2 + 4 * SIGMA * EMIS_WICK * x**3 / h
        # From the boiling point on nothing can be warmer: the balance is as negative as can be.
        value = t - x - latent * (ew - ea) / (p - ew) + radiant / h
        return np.where(ew < p, value, -np.inf), slope

    return _settle(balance, t, p, u, longwave, shortwave, ea)


def _settle(balance, t, *args):
    """Root of a balance (value, slope of its fall) near the air temperature t; NaN if it has none."""
    x, step = t.copy(), t
    for _ in range(NEWTON_STEPS):
        value, slope = balance(x, t, *args)
        step = value / slope
        x = x + step
    settled = np.abs(step) <= TOLERANCE_K
    x = np.where(settled, x, np.nan)
    left = np.flatnonzero(~settled & np.isfinite(t) & np.all([np.isfinite(a) for a in args], axis=0))
    if len(left):
        x[left] = _bisect(balance, t[left], *[a[left] for a in args])
    return x


def _bisect(balance, t, *args):
    out = np.full(len(t), np.nan)
    low, high = np.maximum(t - BRACKET_K[0], 100.0), t + BRACKET_K[1]
    framed = np.flatnonzero((balance(low, t, *args)[0] > 0) & (balance(high, t, *args)[0] < 0))
    if len(framed):
        low, high, t, *args = (a[framed] for a in (low, high, t, *args))
        for _ in range(HALVINGS):
            middle = 0.5 * (low + high)
            above = balance(middle, t, *args)[0] > 0
            low, high = np.where(above, middle, low), np.where(above, high, middle)
        out[framed] = 0.5 * (low + high)
    return out


def _saturation(t):
    return 1.004 * 6.1121 * np.exp(17.502 * (t - 273.15) / (t - 32.18))


def _viscosity(t):
    omega = (t / 97.0 - 2.9) / 0.4 * -0.034 + 1.048
    return 2.6693e-6 * np.sqrt(M_AIR * t) / (3.617**2 * omega)
