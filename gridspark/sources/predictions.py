"""Predictions at the cells stations need, from wide or long result files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.geo import packed_key, round_coordinate
from gridspark.functions.humidity import kelvin_to_celsius, relative_humidity, saturation_hpa
from gridspark.functions.missing import finite
from gridspark.functions.time import stamp_from_parts, timestamp_of
from gridspark.operators.align import align_layers
from gridspark.operators.calendar import day_spine, realign
from gridspark.operators.quality import require_none
from gridspark.operators.reshape import hour_columns, wide_to_long
from gridspark.operators.stations import wanted_cells
from gridspark.sources.layers import day_layer_rows, file_day, list_layer_days, named_path

# Names of prediction columns by layer variable or by long-table column.
MODEL_NAMES = {
    "t2m": "temp_C_model", "ea": "ea_hPa_model", "hi": "HI_C_model", "wbgt": "WBGT_C_model",
    "tmrt": "TMRT_C_model", "utci": "UTCI_C_model",
}
LONG_NAMES = {
    "temp_C_used": "temp_C_model", "rh_pct_used": "rh_pct_model", "HI_C": "HI_C_model",
    "WBGT_C": "WBGT_C_model", "UTCI_C": "UTCI_C_model",
}
KEY = ["key"]
ROW = ["key", "prism_day", "ph"]


def list_pattern(spark: SparkSession, base: str, pattern: str, var: str = "") -> DataFrame:
    """(prism_day, path) of the files under `base` named by `pattern` with {date} and maybe {var}, or folders that Spark wrote."""
    if "{date}" not in pattern:
        raise ValueError(f"pattern must contain {{date}}: {pattern!r}")
    name = pattern.replace("{var}", var)
    before, after = name.split("{date}", 1)
    regex = f"/{re.escape(before)}(\\d{{4}}-\\d{{2}}-\\d{{2}}){re.escape(after)}$"
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        .select(named_path(F.col("path")).alias("path")).distinct()
    )
    day = F.nullif(F.regexp_extract("path", regex, 1), F.lit("")).try_cast("date")
    return listing.select(day.alias("prism_day"), "path").where("prism_day IS NOT NULL")


def _day_of_file() -> Column:
    """Day in the name of the file a row was read from."""
    return F.regexp_extract(named_path(F.col("_metadata.file_path")), r"(\d{4}-\d{2}-\d{2})[^/]*$", 1).cast("date")


def _paths(files: DataFrame, days: DataFrame, skip_missing: bool) -> list[str]:
    """Paths of the requested days; one per calendar day."""
    if not skip_missing:
        require_none(days.join(files, "prism_day", "left_anti"), "no prediction file for days")
    return [r.path for r in files.join(days, "prism_day", "left_semi").select("path").distinct().collect()]


def wide_layer_rows(wide: DataFrame, var: str, prefixes: Sequence[str], wanted: DataFrame | None, decimals: int) -> DataFrame:
    """(key, prism_day, ph, var) of a wide result layer, for wanted cells only."""
    columns = hour_columns(wide.columns, prefixes)
    keyed = wide.withColumn("key", packed_key(F.col("lat"), F.col("lon"), decimals))
    if wanted is not None:
        keyed = wanted_cells(keyed, wanted, KEY)
    return wide_to_long(keyed, ["key", "prism_day"], columns, var, hour="ph")


def read_wide_predictions(
    spark: SparkSession, base: str, pattern: str, variables: Mapping[str, str], start: str, end: str,
    wanted: DataFrame | None, decimals: int = 6,
) -> DataFrame:
    """Model predictions from wide layers; a day lacking any of the variables is skipped.

    `variables` maps a variable to its column prefix.
    """
    days = day_spine(spark, start, end)
    listings = {var: list_pattern(spark, base, pattern, var) for var in variables}
    for files in listings.values():
        days = days.join(files.select("prism_day"), "prism_day", "left_semi")
    layers = {}
    for var, prefix in variables.items():
        paths = _paths(listings[var], days, skip_missing=True)
        if not paths:
            raise FileNotFoundError(f"no complete prediction day in {start}..{end} under {base}")
        layers[var] = wide_layer_rows(spark.read.parquet(*paths), var, [prefix], wanted, decimals)
    return model_predictions(align_layers(layers, ROW, everywhere=False, unique=True))


def model_predictions(layers: DataFrame) -> DataFrame:
    """key, prism_day, time_utc and `*_model` columns from aligned layer variables."""
    have = [v for v in MODEL_NAMES if v in layers.columns]
    out = layers.select(
        "key", "prism_day", timestamp_of(F.col("prism_day"), F.col("ph")).alias("time_utc"),
        *[F.col(v).alias(MODEL_NAMES[v]) for v in have],
    )
    if {"t2m", "ea"} <= set(have):
        out = out.withColumn("rh_pct_model", relative_humidity(F.col("ea_hPa_model"), F.col("temp_C_model")))
    return out


def read_coarse_predictions(
    spark: SparkSession, base: str, start: str, end: str, wanted: DataFrame | None, decimals: int = 4
) -> DataFrame:
    """Coarse-grid predictions from UTC-day layers of t2m and d2m; incomplete days are skipped."""
    days = day_spine(spark, start, end)
    listings = {var: list_layer_days(spark, base, var) for var in ("t2m", "d2m")}
    for files in listings.values():
        for shift in (0, 1):
            have = files.select(F.date_add("d", shift).alias("prism_day"))
            days = days.join(have, "prism_day", "left_semi")
    needed = days.select(F.explode(F.array(F.date_sub("prism_day", 1), "prism_day")).alias("d")).distinct()
    layers = {}
    for var, files in listings.items():
        paths = [r.path for r in files.join(needed, "d", "left_semi").select("path").collect()]
        if not paths:
            raise FileNotFoundError(f"no complete coarse day in {start}..{end} under {base}")
        wide = spark.read.parquet(*paths)
        dated = wide.withColumn("d", file_day(F.col("_metadata.file_path"), var)["d"])
        if wanted is not None:
            # Cells are picked on the packed key before the hours are spread out.
            keyed = dated.withColumn("key", packed_key(
                round_coordinate(F.col("lat"), decimals), round_coordinate(F.col("lon"), decimals), decimals))
            dated = wanted_cells(keyed, wanted, KEY).drop("key")
        rows = day_layer_rows(dated, var, decimals)
        layers[var] = rows.select(packed_key(F.col("lat"), F.col("lon"), decimals).alias("key"), "d", "hr", var)
    hourly = align_layers(layers, ["key", "d", "hr"], everywhere=False, unique=True)
    return coarse_predictions(hourly).join(days, "prism_day", "left_semi")


def coarse_predictions(hourly: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """keys, prism_day, time_utc, temp_C_era, ea_hPa_era, rh_pct_era from Kelvin t2m and d2m."""
    aligned = realign(hourly)
    temp = kelvin_to_celsius(F.col("t2m"))
    ea = saturation_hpa(kelvin_to_celsius(F.col("d2m")))
    return aligned.select(
        *keys, "prism_day", timestamp_of(F.col("prism_day"), F.col("ph")).alias("time_utc"),
        temp.alias("temp_C_era"), ea.alias("ea_hPa_era"), relative_humidity(ea, temp).alias("rh_pct_era"),
    )


def read_long_predictions(
    spark: SparkSession, base: str, pattern: str, start: str, end: str, wanted: DataFrame | None,
    columns: Sequence[str] = tuple(LONG_NAMES), decimals: int = 6, skip_missing: bool = True,
) -> DataFrame:
    """Model predictions from long metric tables, one file or partition per day."""
    days = day_spine(spark, start, end)
    paths = _paths(list_pattern(spark, base, pattern), days, skip_missing)
    if not paths:
        raise FileNotFoundError(f"no prediction day in {start}..{end} under {base}")
    rows = spark.read.parquet(*paths)
    day = _day_of_file()
    return long_predictions(rows.withColumn("prism_day", day), wanted, columns, decimals)


def read_index_predictions(
    spark: SparkSession, long: tuple[str, str] | None, wide: tuple[str, str], start: str, end: str, wanted: DataFrame | None,
    columns: Sequence[str] = tuple(LONG_NAMES), variables: Mapping[str, str] | None = None, decimals: int = 6,
) -> DataFrame:
    """Predictions of the heat-stress indices: a day's long table where there is one, else its wide layers.

    `long` and `wide` are (base, pattern). Wide days need t2m and ea; of hi, wbgt, tmrt and utci those count that any of the days
    has, and a day without one of them lacks its values only. Days that neither has are left out; none at all is an error.
    """
    days = day_spine(spark, start, end)
    in_long = list_pattern(spark, *long).join(days, "prism_day", "left_semi") if long else spark.createDataFrame([], "prism_day date, path string")
    paths = [r.path for r in in_long.select("path").distinct().collect()]  # one a calendar day
    parts = []
    if paths:
        day = _day_of_file()
        parts.append(long_predictions(spark.read.parquet(*paths).withColumn("prism_day", day), wanted, columns, decimals))
    prefixes = dict(variables or {v: v for v in ("t2m", "ea", "hi", "wbgt", "tmrt", "utci")})
    rest = days.join(in_long, "prism_day", "left_anti")
    listings = {v: list_pattern(spark, *wide, v) for v in prefixes}
    for needed in ("t2m", "ea"):
        rest = rest.join(listings[needed].select("prism_day"), "prism_day", "left_semi")
    layers = {}
    for var, prefix in prefixes.items():
        files = _paths(listings[var], rest, skip_missing=True)
        if files:
            day = _day_of_file()
            layers[var] = wide_layer_rows(
                spark.read.parquet(*files).withColumn("prism_day", day), var, [prefix], wanted, decimals)
    if layers:
        # Keys that the temperature layers have; an index may lack them.
        aligned = align_layers(layers, ROW, everywhere=False, unique=True)
        parts.append(model_predictions(aligned.where("t2m IS NOT NULL OR ea IS NOT NULL")))
    if not parts:
        raise FileNotFoundError(f"no prediction day in {start}..{end}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def long_predictions(
    rows: DataFrame, wanted: DataFrame | None, columns: Sequence[str] = tuple(LONG_NAMES), decimals: int = 6
) -> DataFrame:
    """key, prism_day, time_utc and `*_model` columns from long metric rows of wanted cells."""
    missing = {"lat", "lon", "year", "month", "day", "time", *columns} - set(rows.columns)
    if missing:
        raise KeyError(f"missing columns {sorted(missing)}")
    keyed = rows.withColumn("key", packed_key(F.col("lat"), F.col("lon"), decimals))
    if wanted is not None:
        keyed = wanted_cells(keyed, wanted, KEY)
    stamp = stamp_from_parts(*[F.col(c).cast("int") for c in ("year", "month", "day", "time")])
    return keyed.select(
        "key", "prism_day", stamp.alias("time_utc"),
        *[finite(F.col(c).cast("double")).alias(LONG_NAMES.get(c, c)) for c in columns],
    ).dropna(subset=["time_utc"])
