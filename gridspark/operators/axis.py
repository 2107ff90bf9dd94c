"""Nearest grid line per axis, without a nested-loop join.

Gaps between consecutive grid lines are listed under the buckets they touch, so the gap that holds a
value is an equi-join on the bucket plus a range check; the closer end is the answer. Buckets hold about
as many lines each, wherever these lie: their borders are quantiles of the lines.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Most buckets along an axis, which bounds every per-axis summary below, and lines a bucket is meant to hold.
BUCKETS, LINES_PER_BUCKET = 4096, 8


def with_bucket(df: DataFrame, value: Column, borders: list[float], out: str) -> DataFrame:
    """Add `out`, the number of borders up to the value, less one, found by binary search; none are NULL or NaN."""
    if len(borders) == 1:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *borders[1:], float("inf")]
    numbered = Bucketizer(splits=splits, inputCol="_at", outputCol="_slot").transform(df.withColumn("_at", value))
    return numbered.withColumn(out, F.col("_slot").cast("int")).drop("_at", "_slot")


def axis_nearest(targets: DataFrame, grid: DataFrame, target_value: str, grid_value: str, out: str) -> DataFrame:
    """Add `out`, the grid line nearest to `target_value`; rows with a NULL value drop out.

    Values off the grid belong to the edge line, a value exactly between two lines to the larger
    one. The gap table has about one row per grid line, so Spark broadcasts it by its own
    size rule; on a larger one it shuffles on the bucket.
    """
    lines = grid.select(F.col(grid_value).cast("double").alias("line")).where("line IS NOT NULL").distinct()
    # One row of statistics, and the borders: each is a line.
    low, high, count = lines.agg(F.min("line"), F.max("line"), F.count("line")).first()
    if low is None:
        return targets.where("false").withColumn(out, F.lit(None).cast("double"))
    buckets = max(1, min(BUCKETS, count // LINES_PER_BUCKET))
    shares = [n / buckets for n in range(1, buckets)]
    borders = sorted({low, *(lines.agg(F.percentile_approx("line", shares, 10 * BUCKETS)).first()[0] if shares else ())})

    # Gaps between consecutive lines: inside a slot from a window per slot, across slots from the
    # slot edges, a table of at most BUCKETS rows whatever the grid.
    lines = with_bucket(lines, F.col("line"), borders, "slot")
    across = Window.partitionBy(F.lit(0)).orderBy("slot")
    edges = lines.groupBy("slot").agg(F.min("line").alias("first")).select(
        "slot", F.lead("first").over(across).alias("after"), F.lead("slot").over(across).alias("next"))
    following = F.coalesce(F.lead("line").over(Window.partitionBy("slot").orderBy("line")), F.col("after"))
    gaps = lines.join(edges, "slot").select("slot", "next", F.col("line").alias("_left"), following.alias("_right"))
    # A gap ends in its own slot or at the first line of the next one that has any.
    ends = F.when(F.col("_right").isNull(), F.lit(len(borders) - 1)).when(
        F.lead("_left").over(Window.partitionBy("slot").orderBy("_left")).isNull(), F.col("next")).otherwise(F.col("slot"))
    gaps = gaps.withColumn("_to", ends).select(
        "_left", "_right", F.explode(F.sequence("slot", "_to")).alias("_bucket"))

    # Values before the first line count as lying on it.
    value = F.col(target_value).cast("double")
    keyed = targets.withColumn("_value", F.when(value < low, F.lit(low)).otherwise(value))
    keyed = with_bucket(keyed.where("_value IS NOT NULL AND NOT isnan(_value)"), F.col("_value"), borders, "_own")
    hit = (
        (F.col("_own") == F.col("_bucket")) & (F.col("_value") >= F.col("_left"))
        & (F.col("_right").isNull() | (F.col("_value") < F.col("_right")))
    )
    left_closer = F.col("_right").isNull() | (F.col("_value") - F.col("_left") < F.col("_right") - F.col("_value"))
    chosen = F.when(left_closer, F.col("_left")).otherwise(F.col("_right"))
    return keyed.join(gaps, hit).select(*targets.columns, chosen.alias(out))


def grid_nearest(
    targets: DataFrame, grid: DataFrame, lat: str = "lat", lon: str = "lon",
    grid_lat: str = "lat", grid_lon: str = "lon", out_lat: str = "near_lat", out_lon: str = "near_lon",
) -> DataFrame:
    """Add the nearest grid row and column coordinate to every target."""
    by_row = axis_nearest(targets, grid, lat, grid_lat, out_lat)
    return axis_nearest(by_row, grid, lon, grid_lon, out_lon)
