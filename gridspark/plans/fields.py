"""Hourly fields on the fine grid from the coarse and point inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.accumulate import longwave
from gridspark.operators.axis import grid_nearest
from gridspark.operators.calendar import realign
from gridspark.operators.interpolate import idw, pack_hours
from gridspark.operators.neighbours import nearest, with_xy
from gridspark.operators.reshape import half_hour_to_hour
from gridspark.operators.templates import downscale, hourly_template
from gridspark.sources.layers import POINT_KINDS

WEATHER = ("sp", "u10", "v10", "lwdown", "lwnet")
RADIATION = ("ghi", "dhi", "dni", "sza", "alb")
WEATHER_CUTOFF_M = 8000.0
RADIATION_CUTOFF_M = 4000.0


def cell_templates(coarse: DataFrame) -> DataFrame:
    """Template per coarse cell and day, keyed near_lat, near_lon, prism_day.

    `coarse`: lat, lon, d, hr and t2m, d2m in C.
    """
    template = hourly_template(realign(coarse), ["lat", "lon"], "t2m", "d2m")
    return template.withColumnsRenamed({"lat": "near_lat", "lon": "near_lon"})


def temperature_and_humidity(
    daily: DataFrame, coarse: DataFrame, cell_keys: Sequence[str] = ("lat", "lon"), coarse_grid: DataFrame | None = None
) -> DataFrame:
    """cell_keys, prism_day, ph, t2m (C), ea (hPa).

    `daily`: lat, lon, prism_day, tmin, tmax, tdmean. Only the nearest coarse cell is tried; a cell
    whose template is invalid drops out. `coarse_grid` is the static list of coarse cells; without
    it the list is taken from the hourly rows.
    """
    placed = grid_nearest(daily, coarse if coarse_grid is None else coarse_grid)
    return downscale(placed, cell_templates(coarse), cell_keys, ["near_lat", "near_lon"])


def weather_values(coarse: DataFrame, source_id: str = "src_id") -> DataFrame:
    """Packed sp, u10, v10, lwdown, lwnet per source and day.

    `coarse`: source id, d, hr, sp, u10, v10, str, strd (the last two accumulated over the day).
    """
    rows = longwave(coarse, [source_id], carry=["sp", "u10", "v10"])
    return pack_hours(realign(rows), [source_id, "prism_day"], WEATHER)


def radiation_values(half_hours: DataFrame, point: str = "point") -> DataFrame:
    """Packed ghi, dhi, dni, sza, alb per point and day from half-hourly rows."""
    hourly = half_hour_to_hour(half_hours, [point, "d"], POINT_KINDS)
    return pack_hours(realign(hourly), [point, "prism_day"], RADIATION)


def neighbour_table(
    cells: DataFrame, sources: DataFrame, cell_keys: Sequence[str], source_id: str, k: int = 4
) -> DataFrame:
    """Static table of the k nearest sources of every cell; write it once per grid."""
    return nearest(with_xy(cells), with_xy(sources), cell_keys, source_id, k)


def coarse_weather(
    neighbours: DataFrame, coarse: DataFrame, days: DataFrame, cell_keys: Sequence[str],
    source_id: str = "src_id", cutoff_m: float = WEATHER_CUTOFF_M, **options,
) -> DataFrame:
    """cell_keys, prism_day, ph, sp, u10, v10, lwdown, lwnet."""
    return idw(neighbours, weather_values(coarse, source_id), cell_keys, source_id, WEATHER, days,
               cutoff_m=cutoff_m, **options)


def radiation(
    neighbours: DataFrame, half_hours: DataFrame, days: DataFrame, cell_keys: Sequence[str],
    point: str = "point", cutoff_m: float = RADIATION_CUTOFF_M, **options,
) -> DataFrame:
    """cell_keys, prism_day, ph, ghi, dhi, dni, sza, alb."""
    return idw(neighbours, radiation_values(half_hours, point), cell_keys, point, RADIATION, days,
               cutoff_m=cutoff_m, **options)

