"""Day spines and completeness of 12Z-to-12Z days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridspark.functions.time import day_from_doy, shifted_day_of, shifted_hour_of


def day_spine(spark: SparkSession, start: str, end: str, day: str = "prism_day") -> DataFrame:
    """All days from `start` to `end`, both included; an end before the start is an error."""
    if end < start:
        raise ValueError(f"end {end} is before start {start}")
    span = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY"))
    return spark.range(1).select(F.explode(span).alias(day))


def doy_spine(spark: SparkSession, year: int, first: int, last: int, day: str = "prism_day") -> DataFrame:
    """As `day_spine`, from a year and two days of year."""
    if last < first:
        raise ValueError(f"day of year {last} is before {first}")
    return spark.range(first, last + 1).select(day_from_doy(F.lit(year), F.col("id")).alias(day))


def realign(df: DataFrame, utc_day: str = "d", hour: str = "hr") -> DataFrame:
    """Replace a UTC day and hour by the label and position of the 12Z-to-12Z day; no join."""
    return df.select(
        *[c for c in df.columns if c not in (utc_day, hour)],
        shifted_day_of(F.col(utc_day), F.col(hour)).alias("prism_day"),
        shifted_hour_of(F.col(hour)).alias("ph"),
    )


def present_both_days(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep realigned rows of keys seen in both UTC days that make up the window."""
    w = Window.partitionBy(*keys, "prism_day")
    return (
        df.withColumn("_early", F.max(F.col("ph") < 12).over(w))
        .withColumn("_late", F.max(F.col("ph") >= 12).over(w))
        .where("_early AND _late")
        .drop("_early", "_late")
    )
