"""Stations: distance rules, cell lookup, subset, and observation restriction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def keep_flags(stations: DataFrame, model_m: float = 800.0, coarse_m: float = 9000.0) -> DataFrame:
    """keep_model, keep_era and keep_both from the two distances."""
    near = (F.col("dist_m_model") <= model_m, F.col("dist_m_era") <= coarse_m)
    return stations.withColumns({"keep_model": near[0], "keep_era": near[1], "keep_both": near[0] & near[1]})


def flag_counts(stations: DataFrame) -> DataFrame:
    """One row: candidates and how many each distance rule keeps."""
    return stations.agg(
        F.count(F.lit(1)).alias("candidates"),
        *[F.count_if(c).alias(f"n_{c}") for c in ("keep_model", "keep_era", "keep_both")],
    )


def wanted_cells(layer: DataFrame, stations: DataFrame, cell_keys: Sequence[str]) -> DataFrame:
    """Rows of the layer on a cell some station uses."""
    return layer.join(stations.select(*cell_keys), list(cell_keys), "left_semi")


def on_stations(layer: DataFrame, stations: DataFrame, cell_keys: Sequence[str], station: str = "station_id") -> DataFrame:
    """Cell values for every station on the cell; stations sharing a cell each get them."""
    return layer.join(stations.select(station, *cell_keys), list(cell_keys))


def with_observations(stations: DataFrame, observations: DataFrame, station: str = "station_id") -> DataFrame:
    """Stations that have an observation."""
    return stations.join(observations.select(station), station, "left_semi")


def first_coordinates(observations: DataFrame, station: str = "station_id", time: str = "time_utc") -> DataFrame:
    """One coordinate pair per station: that of its earliest observation, lowest on a tie."""
    earliest = F.min(F.struct(time, "LAT", "LON"))
    return observations.groupBy(station).agg(earliest.alias("_f")).select(station, "_f.LAT", "_f.LON")


def spread_subset(
    stations: DataFrame, n: int, seed: int = 11, step_deg: float = 5.0, lat: str = "LAT", lon: str = "LON",
    station: str = "station_id", order=None,
) -> DataFrame:
    """`n` stations spread over the map: one per latitude-longitude square per round.

    Within a square the order is a seeded hash of the id (or the Column `order`). A square
    contributes at most `n` stations to the ranking, which cannot change the first `n` overall.
    """
    order = F.xxhash64(F.col(station), F.lit(seed)) if order is None else order
    squares = stations.withColumns({
        "_row": F.floor(F.col(lat) / step_deg), "_col": F.floor(F.col(lon) / step_deg), "_order": order})
    ranked = squares.withColumn(
        "_round", F.row_number().over(Window.partitionBy("_row", "_col").orderBy("_order", station))
    ).where(F.col("_round") <= n)
    return ranked.orderBy("_round", "_order", station).limit(n).select(*stations.columns)
