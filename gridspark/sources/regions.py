"""Cell-to-region maps, region codes, representative points and population."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_region_map(spark: SparkSession, path: str, vintage: int) -> DataFrame:
    """(key, tract_code) of one census vintage; `vintage` is a partition column."""
    return spark.read.parquet(path).where(F.col("vintage") == vintage).select(
        F.col("key").cast("bigint"), F.col("tract_code").cast("int"))


def read_region_codes(spark: SparkSession, path: str, vintage: int) -> DataFrame:
    """(tract_code, GEOID) of one vintage."""
    return spark.read.parquet(path).where(F.col("vintage") == vintage).select(
        F.col("tract_code").cast("int"), F.col("GEOID").cast("string"))


def read_representative_points(spark: SparkSession, path: str) -> DataFrame:
    """(GEOID, lat, lon), made once from the region shapes outside this engine."""
    return spark.read.parquet(path).select(
        F.col("GEOID").cast("string"), F.col("lat").cast("double"), F.col("lon").cast("double"))


def resolve_population_years(
    years: DataFrame, available: DataFrame, fallback_year: int = 2000, max_year: int = 2020, strict: bool = True
) -> DataFrame:
    """(yr, pop_year): the year itself, else for years before 2000 the fallback year.

    A year without population is an error (its own message past `max_year`); with `strict` off
    the message is returned in `problem` instead.
    """
    have = available.select(F.col("yr").alias("pop_year")).distinct()
    asked = years.select("yr").distinct()
    options = asked.withColumn("pop_year", F.explode(F.when(
        F.col("yr") < 2000, F.array(F.col("yr"), F.lit(fallback_year).cast(dict(asked.dtypes)["yr"]))
    ).otherwise(F.array("yr"))))
    usable = options.join(have, "pop_year", "left_semi").groupBy("yr").agg(
        F.max(F.struct(F.col("pop_year") == F.col("yr"), "pop_year"))["pop_year"].alias("pop_year"))
    resolved = asked.join(usable, "yr", "left")
    problem = F.when(F.col("pop_year").isNotNull(), F.lit(None)).when(
        F.col("yr") > max_year, F.lit(f"population ends at {max_year}")
    ).otherwise(F.lit("no population for the year"))
    if not strict:
        return resolved.withColumn("problem", problem)
    checked = F.when(problem.isNull(), F.col("pop_year")).otherwise(
        F.raise_error(F.concat(problem, F.lit(": "), F.col("yr").cast("string"))))
    return resolved.withColumn("pop_year", checked)


def population_of_years(population: DataFrame, resolved: DataFrame) -> DataFrame:
    """Population rows per requested year: `yr` is the requested, `pop_year` the used year."""
    return population.withColumnRenamed("yr", "pop_year").join(resolved.select("yr", "pop_year"), "pop_year")
