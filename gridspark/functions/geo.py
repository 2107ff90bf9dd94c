"""Coordinates: keys, rounding, boxes, projection and area weights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Contiguous-US bounding box in degrees, inclusive.
CONUS_LAT = (24.0, 50.5)
CONUS_LON = (-125.0, -66.0)

# Conic equal-area projection of the contiguous US on the GRS80 ellipsoid.
SEMI_MAJOR_M = 6378137.0
ECCENTRICITY_SQ = 0.00669438002290
PARALLELS = (29.5, 45.5)
ORIGIN = (23.0, -96.0)


def packed_key(lat: Column, lon: Column, decimals: int = 6) -> Column:
    """One bigint per coordinate pair: rounded latitude times 1e9 plus rounded longitude."""
    scale = F.lit(float(10**decimals))
    part = lambda c: F.rint(c.cast("double") * scale).cast("bigint")
    return part(lat) * F.lit(1_000_000_000) + part(lon)


def interleaved(lat: Column, lon: Column, bits: int = 16) -> Column:
    """Place on a Z-shaped curve through the world's squares, 360 / 2^bits degrees wide: near places have near numbers.

    The bits of both coordinates' squares take turns, latitude first; NULL where one is missing.
    """
    squares = 1 << bits

    def square(value: Column) -> Column:
        raw = F.floor((value.cast("double") + 180) * (squares / 360.0)).cast("bigint")
        return F.least(F.greatest(raw, F.lit(0)), F.lit(squares - 1))

    def spread(value: Column) -> Column:
        # Halve the distance between bits that stay together until every bit has a free place beside it.
        step = bits // 2
        while step:
            mask = sum(1 << n for n in range(2 * bits) if n // step % 2 == 0)
            value = F.shiftleft(value, step).bitwiseOR(value).bitwiseAND(F.lit(mask))
            step //= 2
        return value

    place = F.shiftleft(spread(square(lat)), 1).bitwiseOR(spread(square(lon)))
    return F.when(lat.isNotNull() & lon.isNotNull(), place)


def round_coordinate(value: Column, decimals: int = 6) -> Column:
    """Half-even rounding in double, like the keys."""
    scale = F.lit(float(10**decimals))
    return F.rint(value.cast("double") * scale) / scale


def in_conus(lat: Column, lon: Column) -> Column:
    return lat.between(*CONUS_LAT) & lon.between(*CONUS_LON)


def area_weight(lat: Column, use_cosine: bool = True) -> Column:
    """cos(latitude), never negative; a constant 1 when `use_cosine` is off."""
    if not use_cosine:
        return F.lit(1.0)
    weight = F.cos(F.radians(lat.cast("double")))
    return F.when(weight > 0, weight).otherwise(F.lit(0.0))


def cell_center(index: Column, origin: float, step: float) -> Column:
    """Centre coordinate of a raster row or column."""
    return F.lit(origin) + (index + F.lit(0.5)) * F.lit(step)


def albers_xy(
    lat: Column,
    lon: Column,
    semi_major: float = SEMI_MAJOR_M,
    eccentricity_sq: float = ECCENTRICITY_SQ,
    parallels: tuple[float, float] = PARALLELS,
    origin: tuple[float, float] = ORIGIN,
) -> tuple[Column, Column]:
    """Equal-area x and y in metres (Snyder 1987, ellipsoidal case)."""
    ecc = math.sqrt(eccentricity_sq)

    def q_value(sin_lat: float) -> float:
        es = ecc * sin_lat
        return (1 - eccentricity_sq) * (
            sin_lat / (1 - es * es) - math.log((1 - es) / (1 + es)) / (2 * ecc)
        )

    def m_squared(deg: float) -> float:
        s = math.sin(math.radians(deg))
        return (1 - s * s) / (1 - eccentricity_sq * s * s)

    q1, q2, q0 = (q_value(math.sin(math.radians(d))) for d in (*parallels, origin[0]))
    m1, m2 = m_squared(parallels[0]), m_squared(parallels[1])
    cone = (m1 - m2) / (q2 - q1)
    const = m1 + cone * q1
    rho0 = semi_major * math.sqrt(const - cone * q0) / cone

    sin_lat = F.sin(F.radians(lat.cast("double")))
    es = F.lit(ecc) * sin_lat
    q = F.lit(1 - eccentricity_sq) * (
        sin_lat / (F.lit(1.0) - es * es)
        - F.ln((F.lit(1.0) - es) / (F.lit(1.0) + es)) / F.lit(2 * ecc)
    )
    rho = F.lit(semi_major / cone) * F.sqrt(F.lit(const) - F.lit(cone) * q)
    theta = F.lit(cone) * F.radians(lon.cast("double") - F.lit(origin[1]))
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def inverse_distance_weight(dist: Column, power: float = 1.0, eps: float = 1e-6) -> Column:
    base = F.when(dist < eps, F.lit(eps)).otherwise(dist)
    return F.lit(1.0) / (base if power == 1.0 else F.pow(base, F.lit(float(power))))
