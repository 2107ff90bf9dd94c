"""Gridded inputs: hourly day-layers, daily cells, half-hourly points, grids."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.geo import cell_center, round_coordinate
from gridspark.functions.humidity import kelvin_to_celsius
from gridspark.functions.missing import finite, sentinel_to_null
from gridspark.operators.quality import require_none, require_unique
from gridspark.operators.reshape import hour_columns, wide_to_long

# File names of the half-hourly point layers.
POINT_FILES = {
    "ghi": "ghi.parquet",
    "dhi": "dhi.parquet",
    "dni": "dni.parquet",
    "sza": "solar_zenith_angle.parquet",
    "alb": "surface_albedo.parquet",
}
POINT_KINDS = {"ghi": "flux", "dhi": "flux", "dni": "flux", "sza": "zenith", "alb": "albedo"}
SLOT_COLUMNS = [f"ts_{i:03d}" for i in range(48)]


def named_path(path: Column) -> Column:
    """The path that carries a layer's name: the file, or the folder of a part that Spark wrote."""
    return F.regexp_replace(path, "/part-[^/]+$", "")


def file_day(path: Column, var: str) -> Column:
    """struct<d, priority> of the name of a day-layer, a file or a folder that Spark wrote; NULL when it follows none of the four forms.

    In order of preference: MM-DD-YYYY, YYYY-MM-DD, YYYY-MM-DD_<var>, MM-DD-YYYY_<var>.
    """
    name = named_path(path)
    american, iso = r"(\d{2}-\d{2}-\d{4})", r"(\d{4}-\d{2}-\d{2})"
    forms = [(american, "MM-dd-yyyy", ""), (iso, "yyyy-MM-dd", ""),
             (iso, "yyyy-MM-dd", f"_{var}"), (american, "MM-dd-yyyy", f"_{var}")]
    options = []
    for priority, (pattern, fmt, tail) in enumerate(forms):
        text = F.regexp_extract(name, f"(?:^|/){pattern}{tail}\\.parquet$", 1)
        stamp = F.call_function("try_to_timestamp", F.nullif(text, F.lit("")), F.lit(fmt))
        day = stamp.cast("date")
        options.append(F.when(day.isNotNull(), F.struct(day.alias("d"), F.lit(priority).alias("priority"))))
    return F.coalesce(*options)


def list_layer_days(spark: SparkSession, base: str, var: str) -> DataFrame:
    """(layer, d, path) of the day-layers under `<base>/<var>`, the preferred file of each day.

    Only the listing is read, no file contents.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").load(f"{base}/{var}").select("path")
    )
    listing = listing.select(named_path(F.col("path")).alias("path"))
    found = listing.withColumn("_f", file_day(F.col("path"), var)).where("_f IS NOT NULL")
    return found.groupBy(F.col("_f.d").alias("d")).agg(
        F.min_by("path", F.col("_f.priority")).alias("path")
    ).select(F.lit(var).alias("layer"), "d", "path")


def read_day_layers(
    spark: SparkSession, base: str, var: str, start: str, end: str, decimals: int = 6,
    kelvin: bool = False, reject_duplicates: bool = False,
) -> DataFrame:
    """Long rows (lat, lon, d, hr, <var>) of the UTC days start..end; a day without a file is an error."""
    wanted = spark.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY"))).alias("d"))
    files = list_layer_days(spark, base, var).join(wanted, "d", "left_semi")
    require_none(wanted.join(files, "d", "left_anti"), f"no {var} layer for days")
    # One path per calendar day of the request.
    paths = [r.path for r in files.select("path").collect()]
    wide = spark.read.parquet(*paths)
    days = wide.withColumn("d", file_day(F.col("_metadata.file_path"), var)["d"])
    return day_layer_rows(days, var, decimals, kelvin, reject_duplicates)


def day_layer_rows(
    wide: DataFrame, var: str, decimals: int = 6, kelvin: bool = False, reject_duplicates: bool = False
) -> DataFrame:
    """Long rows from wide day-layers that carry lat, lon and d."""
    columns = hour_columns(wide.columns, [var])
    wide = wide.select(
        round_coordinate(F.col("lat"), decimals).alias("lat"), round_coordinate(F.col("lon"), decimals).alias("lon"),
        "d", *columns)
    if reject_duplicates:
        require_unique(wide, ["lat", "lon", "d"], f"{var} layer")
    rows = wide_to_long(wide, ["lat", "lon", "d"], columns, var)
    return rows.withColumn(var, kelvin_to_celsius(F.col(var))) if kelvin else rows


def daily_cells(
    tmin: DataFrame, tmax: DataFrame, tdmean: DataFrame, nodata: float | None,
    origin: tuple[float, float], step: tuple[float, float], day: str = "prism_day",
) -> DataFrame:
    """(row, col, lat, lon, day, tmin, tmax, tdmean) from three cell tables (row, col, day, value).

    Nodata becomes NULL; the three layers must cover the same cells.
    """
    keys = ["row", "col", day]
    tagged = None
    for name, layer in (("tmin", tmin), ("tmax", tmax), ("tdmean", tdmean)):
        value = sentinel_to_null(F.col("value").cast("double"), nodata)
        rows = layer.select(*keys, *[
            (value if n == name else F.lit(None).cast("double")).alias(n) for n in ("tmin", "tmax", "tdmean")
        ], F.lit(1).alias("_n"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    cells = tagged.groupBy(*keys).agg(
        F.max("tmin").alias("tmin"), F.max("tmax").alias("tmax"), F.max("tdmean").alias("tdmean"), F.sum("_n").alias("_n"))
    agreed = F.when(F.col("_n") == 3, cell_center(F.col("row"), origin[0], step[0])).otherwise(
        F.raise_error(F.lit("daily layers do not cover the same cells")))
    return cells.withColumns({"lat": agreed, "lon": cell_center(F.col("col"), origin[1], step[1])}).drop("_n")


def read_point_layers(spark: SparkSession, base: str, start: str, end: str, variables: Sequence[str] = tuple(POINT_FILES)) -> DataFrame:
    """Long half-hourly rows (point, d, slot, one column per variable) of the UTC days start..end.

    Layout: `<base>/<year>/<YYYY-MM-DD>/<file>`, each a file or a folder that Spark wrote. A point absent from one
    variable's layer is missing in that variable only. A variable without a layer on a wanted day is an error, and
    so is a point listed twice in a layer.
    """
    from gridspark.operators.align import align_layers

    layers, found = {}, None
    for var in variables:
        wide = spark.read.parquet(f"{base}/*/*/{POINT_FILES[var]}")
        folder = F.regexp_extract(
            F.col("_metadata.file_path"), rf"/(\d{{4}}-\d{{2}}-\d{{2}})/{re.escape(POINT_FILES[var])}(?:/[^/]+)?$", 1)
        day = F.nullif(folder, F.lit("")).cast("date")
        dated = wide.withColumn("d", day).where(F.col("d").between(start, end))
        days = dated.select(F.lit(var).alias("layer"), "d").distinct()
        found = days if found is None else found.union(days)
        layers[var] = wide_to_long(dated, ["point", "d"], SLOT_COLUMNS, var, hour="slot")
    wanted = spark.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY"))).alias("d"))
    expected = wanted.select(F.explode(F.array(*[F.lit(v) for v in variables])).alias("layer"), "d")
    require_none(expected.join(found, ["layer", "d"], "left_anti"), "no half-hourly layer for")
    return align_layers(layers, ["point", "d", "slot"], everywhere=False, unique=True)


def point_metadata(df: DataFrame) -> DataFrame:
    """(point, lat, lon) of the points that have coordinates."""
    return df.select(
        "point", finite(F.col("latitude").cast("double")).alias("lat"), finite(F.col("longitude").cast("double")).alias("lon")
    ).dropna(subset=["lat", "lon"])


def target_grid(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Distinct rounded cells of a sample layer."""
    return df.select(
        round_coordinate(F.col("lat"), decimals).alias("lat"), round_coordinate(F.col("lon"), decimals).alias("lon")
    ).dropDuplicates()
