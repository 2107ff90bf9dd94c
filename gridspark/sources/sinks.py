"""Writers. Days are partitions, so a rerun replaces exactly the days it computed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.geo import interleaved
from gridspark.functions.time import time_columns
from gridspark.operators.reshape import long_to_wide

# Column order of the long metric table.
LONG_COLUMNS = (
    "lat", "lon", "day", "month", "year", "time", "temp_C_used", "rh_pct_used", "HI_C", "WBGT_C", "UTCI_C",
)
# Rows that one task lays out and writes.
ROWS_PER_FILE = 1_000_000
# What makes a regional result, and its partitions.
RESULT_KEYS = ("prism_day", "pop_year", "vintage")
_NARROW = {"day": "tinyint", "month": "tinyint", "year": "smallint", "time": "tinyint"}


def narrow(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Storage types: float measures and coordinates, small integers for time parts."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if field.name in keep:
            pass
        elif field.name in _NARROW:
            column = column.cast(_NARROW[field.name])
        elif isinstance(field.dataType, (T.DoubleType, T.DecimalType)):
            column = column.cast("float")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def write_days(df: DataFrame, path: str, partitions: Sequence[str] = ("prism_day",), sort: Sequence[str] = ()) -> None:
    """zstd Parquet partitioned by day; only the days in `df` are replaced.

    The rebalance hint gathers a day in few files and splits a day too large for one, without the
    sampling pass of a range partitioning; sorting makes file statistics help later cell lookups.
    """
    order = [*partitions, *sort]
    (
        df.hint("rebalance", *[F.col(p) for p in partitions]).sortWithinPartitions(*order).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .partitionBy(*partitions).parquet(path)
    )


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None) -> None:
    """A table in the catalogue, bucketed by the keys of its joins, one file a bucket.

    Tables with the same keys and number of buckets join without moving a row, however often; the rows are dealt once, here.
    """
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("compression", "zstd")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def lookup_files(rows: int, least: int = 1) -> int:
    """Files for so many rows, each of at most ROWS_PER_FILE."""
    return max(least, -(-rows // ROWS_PER_FILE))


def write_for_lookups(
    df: DataFrame, path: str, key: str, files: int, lat: str = "lat", lon: str = "lon", row_group_bytes: int = 8 << 20,
    keys_in_group: int = 100_000,
) -> None:
    """Rows laid out for reading few cells: along the Z-curve of their coordinates, so that a box touches few row groups by their
    ranges of lat and lon, with a Bloom filter of `key` in every row group, so that single cells are found as well.

    One task writes a file, so `files` should grow with the rows, see `lookup_files`. The cells of one place on the curve may lie in
    several files.
    """
    place = interleaved(F.col(lat), F.col(lon))
    (
        df.withColumn("_z", place).repartitionByRange(files, "_z", key).sortWithinPartitions("_z", key).drop("_z")
        .write.option("compression", "zstd").option("parquet.block.size", row_group_bytes)
        .option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", keys_in_group)
        .option(f"parquet.enable.dictionary#{key}", "false").parquet(path)
    )


def write_layer(df: DataFrame, path: str, value: str, name: str | None = None) -> None:
    """Wide day layer lat, lon, prism_day, `<name>_ph00..ph23` from hourly rows."""
    wide = long_to_wide(df, ["lat", "lon", "prism_day"], value, "ph", f"{name or value}_ph")
    write_days(narrow(wide), path, sort=["lat", "lon"])


def write_long(df: DataFrame, path: str, time_mode: str = "utc") -> None:
    """Long metric table partitioned by day."""
    stamped = df.withColumns(time_columns(F.col("prism_day"), F.col("ph"), time_mode))
    write_days(narrow(stamped.select(*LONG_COLUMNS, "prism_day")), path, sort=["lat", "lon"])


def write_regions(
    df: DataFrame, path: str, vintage: int, pop_year: str | None = "pop_year", time_mode: str = "utc"
) -> None:
    """Regional table partitioned by day, population year and vintage."""
    stamped = df.withColumns({**time_columns(F.col("prism_day"), F.col("ph"), time_mode), "vintage": F.lit(vintage)})
    if pop_year is None or pop_year not in df.columns:
        stamped = stamped.withColumn("pop_year", F.lit(None).cast("int"))
    head = ["GEOID", "lat", "lon", "day", "month", "year", "time"]
    parts = list(RESULT_KEYS)
    values = [c for c in stamped.columns if c not in (*head, *parts, "ph")]
    write_days(narrow(stamped.select(*head, *values, *parts), keep=parts), path, parts, sort=["GEOID"])


def finished_results(spark: SparkSession, path: str) -> DataFrame:
    """(prism_day, pop_year, vintage) already present in a regional table; empty when there is none yet.

    All three are partition columns, so no file contents are read.
    """
    try:
        table = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return spark.createDataFrame([], "prism_day date, pop_year int, vintage int")
        raise
    return table.select(
        "prism_day", *[(F.col(c) if c in table.columns else F.lit(None)).cast("int").alias(c) for c in RESULT_KEYS[1:]]
    ).distinct()


# Inside a table; readers pass over names that start with an underscore.
COMMITS = "_commits"


def record_commits(done: DataFrame, path: str) -> None:
    """Note results (prism_day, and pop_year, vintage, fingerprint where they apply) as complete, once they are written to `path`.

    Partitions of a run that died halfway carry no note, so they are made again.
    """
    columns = {"prism_day": "date", "pop_year": "int", "vintage": "int", "fingerprint": "string"}
    done.select(*[
        (F.col(c) if c in done.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()
    ]).withColumn("noted", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/{COMMITS}")


def committed_results(spark: SparkSession, path: str) -> DataFrame:
    """(prism_day, pop_year, vintage, fingerprint) of the complete results, each with its last fingerprint.

    A table without any notes, written before there were any, counts by its partitions and has no fingerprints.
    """
    try:
        notes = spark.read.parquet(f"{path}/{COMMITS}")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return finished_results(spark, path).withColumn("fingerprint", F.lit(None).cast("string"))
        raise
    return notes.groupBy(*RESULT_KEYS).agg(F.max_by("fingerprint", "noted").alias("fingerprint"))


def read_long(spark: SparkSession, path: str, days: Sequence, time_mode: str = "utc") -> DataFrame:
    """Cells and hours of the long metric table: lat, lon (single precision), prism_day, ph and the metrics of the given days."""
    ph = F.col("time").cast("int") if time_mode == "prism" else (F.col("time").cast("int") + 12) % 24
    table = spark.read.parquet(path).where(F.col("prism_day").isin(list(days)))
    return table.select("lat", "lon", "prism_day", ph.alias("ph"), *LONG_COLUMNS[6:])


def finished_days(spark: SparkSession, path: str) -> DataFrame:
    """Days already present in a written table; empty when there is no table yet."""
    return finished_results(spark, path).select("prism_day").distinct()


def write_report(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A summary as CSV with header."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", "true").csv(path)


def write_suite(suite: dict[str, DataFrame], folder: str, prefix: str, tag: str) -> None:
    """The three summaries of a metric suite as CSV."""
    for level, df in suite.items():
        keys = [c for c in ("station_id", "prism_day", "var") if c in df.columns]
        write_report(df, f"{folder}/metrics_{level}_{prefix}_{tag}", keys)


def write_pairs(df: DataFrame, path: str, as_csv: bool = False) -> None:
    """Matched pairs, as Parquet or CSV."""
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if as_csv else writer.parquet(path)


