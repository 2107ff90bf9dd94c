"""Static grid tables: distinct rounded cells of a sample layer with projected coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.geo import packed_key
from gridspark.operators.neighbours import with_xy
from gridspark.sources.layers import target_grid


def grid_table(sample: DataFrame, decimals: int = 6) -> DataFrame:
    """key, lat, lon, x, y; one row per cell."""
    cells = with_xy(target_grid(sample, decimals))
    return cells.select(packed_key(F.col("lat"), F.col("lon"), decimals).alias("key"), "lat", "lon", "x", "y")
