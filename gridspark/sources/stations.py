"""Station lists and observations: text formats to typed rows.

Each format has a parser from raw lines or strings (DataFrame in, DataFrame out) and a reader
that adds the file access.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.geo import in_conus
from gridspark.functions.humidity import relative_humidity, saturation_hpa, vapor_pressure
from gridspark.functions.missing import finite
from gridspark.functions.time import stamp_from_parts, stamp_from_text
from gridspark.operators.quality import worst_groups

MISSING = "-9999"
# Fields that a station line has at least: date and hour, temperature, dewpoint.
ISD_FIELDS = 6

# Column order of the hourly station CSV.
HEAT01_COLUMNS = (
    "WBANNO", "DATE_TIME", "LONGITUDE", "LATITUDE", "RELATIVE_HUMIDITY", "SURFACE_PRESSURE",
    "SOLAR_RADIATION", "ESTIMATED_10_METER_WIND_SPEED", "DRY_BULB_TEMPERATURE_C", "HEAT_INDEX_C",
    "APPARENT_TEMPERATURE_C", "WET_BULB_GLOBE_TEMPERATURE_C", "DRY_BULB_TEMPERATURE_F",
    "HEAT_INDEX_F", "APPARENT_TEMPERATURE_F", "WET_BULB_GLOBE_TEMPERATURE_F",
)
# Station-name prefixes outside the contiguous US.
EXCLUDED_PREFIXES = ("AK_", "HI_", "PR_", "VI_", "GU_", "AS_", "MP_")
# Spellings of a missing value.
HEAT01_MISSING = ("-9999", "-9999.0", "NA", "")


def _number(text: Column) -> Column:
    return finite(F.trim(text).try_cast("double"))


def parse_station_history(df: DataFrame, start: str, end: str, conus_only: bool = True) -> DataFrame:
    """US stations with coordinates whose record covers [start, end]; all input columns are strings."""
    day = lambda c: F.call_function("try_to_timestamp", F.trim(c), F.lit("yyyyMMdd")).cast("date")
    out = df.select(
        F.lpad(F.trim("USAF"), 6, "0").alias("USAF"), F.lpad(F.trim("WBAN"), 5, "0").alias("WBAN"), "CTRY",
        _number(F.col("LAT")).alias("LAT"), _number(F.col("LON")).alias("LON"),
        day(F.col("BEGIN")).alias("BEGIN"), day(F.col("END")).alias("END"),
    )
    out = out.where(
        (F.col("CTRY") == "US") & F.col("LAT").isNotNull() & F.col("LON").isNotNull()
        & (F.col("BEGIN") <= F.lit(start).cast("date")) & (F.col("END") >= F.lit(end).cast("date"))
    )
    if conus_only:
        out = out.where(in_conus(F.col("LAT"), F.col("LON")))
    return out.withColumn("station_id", F.concat_ws("-", "USAF", "WBAN"))


def read_station_history(spark: SparkSession, path: str, start: str, end: str, conus_only: bool = True) -> DataFrame:
    return parse_station_history(spark.read.csv(path, header=True), start, end, conus_only)


def parse_isd_lite(lines: DataFrame, station: str = "station_id", text: str = "value") -> DataFrame:
    """station_id, time_utc, temp_C_obs, ea_hPa_obs, rh_pct_obs from whitespace-separated lines.

    Twelve columns, tenths of a degree, -9999 missing. Rows without a temperature and lines that cannot be read (see
    `rejected_isd_lite`) drop out; a missing dewpoint leaves the humidity columns NULL.
    """
    typed = typed_isd_lite(lines, station, text).where("problem IS NULL").dropna(subset=["temp_C_obs"]).drop("problem")
    return typed.withColumn("ea_hPa_obs", saturation_hpa(F.col("_td"))).withColumn(
        "rh_pct_obs", relative_humidity(F.col("ea_hPa_obs"), F.col("temp_C_obs"))
    ).drop("_td")


def typed_isd_lite(lines: DataFrame, station: str = "station_id", text: str = "value") -> DataFrame:
    """station, time_utc, temp_C_obs, _td and `problem`: why a line cannot be read (fields, time, temperature or dewpoint), else NULL.

    A value marked as missing is no problem.
    """
    lines = lines.select(station, F.split(F.trim(text), r"\s+").alias("_parts"))
    field = lambda i: F.get("_parts", F.lit(i))
    whole = lambda i: field(i).try_cast("int")
    tenths = lambda i: F.nullif(field(i), F.lit(MISSING)).try_cast("double") / 10.0
    no_number = lambda i: field(i).try_cast("double").isNull()
    stamp = stamp_from_parts(whole(0), whole(1), whole(2), whole(3))
    problem = F.when(F.size("_parts") < ISD_FIELDS, "fields").when(stamp.isNull(), "time").when(
        no_number(4), "temperature").when(no_number(5), "dewpoint")
    return lines.select(station, stamp.alias("time_utc"), tenths(4).alias("temp_C_obs"), tenths(5).alias("_td"),
                        problem.alias("problem"))


def rejected_isd_lite(lines: DataFrame, station: str = "station_id", text: str = "value") -> DataFrame:
    """(station, problem, n): lines that the parser cannot read, by what is wrong with them."""
    return typed_isd_lite(lines, station, text).where("problem IS NOT NULL").groupBy(station, "problem").agg(
        F.count(F.lit(1)).alias("n"))


def read_isd_lite(
    spark: SparkSession, path: str, stations: Sequence[str] | None = None, years: Sequence[int] | None = None
) -> DataFrame:
    """Station-year files `<USAF>-<WBAN>-<year>.gz` under `path`; the id comes from the name.

    Files of other stations or years, where these are given, are left out by name and never opened.
    """
    wanted = "*.gz" if years is None else "{" + ",".join(f"*-{y:04d}.gz" for y in years) + "}"
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", wanted).text(path)
    if stations is not None:
        # A network has some thousand stations: the names are literals, which skip files while listing them.
        name = F.col("_metadata.file_name")
        lines = lines.where(F.substring(name, 1, F.length(name) - F.lit(len("-2000.gz"))).isin(list(stations)))
    station = F.regexp_extract(F.col("_metadata.file_name"), r"^(\w+-\w+)-\d{4}\.gz$", 1)
    return parse_isd_lite(lines.select(station.alias("station_id"), "value"))


def parse_heat01(df: DataFrame, year: int | None = None) -> DataFrame:
    """Typed hourly observations from the 16 string columns of the station CSV.

    Embedded header rows and rows missing a required value or outside the contiguous US drop out.
    """
    value = lambda c: F.when(~F.trim(c).isin(*HEAT01_MISSING), F.trim(c))
    number = lambda c: finite(value(F.col(c)).try_cast("double"))
    out = df.where(F.trim("WBANNO") != "WBANNO").select(
        F.lpad(value(F.col("WBANNO")).try_cast("int").cast("string"), 5, "0").alias("station_id"),
        stamp_from_text(value(F.col("DATE_TIME"))).alias("time_utc"),
        number("LATITUDE").alias("LAT"), number("LONGITUDE").alias("LON"),
        number("DRY_BULB_TEMPERATURE_C").alias("temp_C_obs"), number("RELATIVE_HUMIDITY").alias("rh_pct_obs"),
        number("HEAT_INDEX_C").alias("HI_C_obs"), number("WET_BULB_GLOBE_TEMPERATURE_C").alias("WBGT_C_obs"),
    ).dropna().where(in_conus(F.col("LAT"), F.col("LON")))
    if year is not None:
        out = out.where(F.year("time_utc") == year)
    return out.withColumn("ea_hPa_obs", vapor_pressure(F.col("rh_pct_obs"), F.col("temp_C_obs"))).select(
        "station_id", "time_utc", "LAT", "LON", "temp_C_obs", "ea_hPa_obs", "rh_pct_obs", "HI_C_obs", "WBGT_C_obs")


def conus_station_name(name: Column) -> Column:
    """False for the prefixes of stations outside the contiguous US."""
    return ~F.substring(name, 1, 3).isin(*EXCLUDED_PREFIXES)


def read_heat01(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """Station files `CRNHE0101-<name>.csv` under `path`; malformed lines are skipped."""
    schema = ", ".join(f"{c} STRING" for c in HEAT01_COLUMNS)
    rows = (
        spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "CRNHE0101-*.csv").csv(path)
    )
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^CRNHE0101-(.+)\.csv$", 1)
    return parse_heat01(rows.where(conus_station_name(name)), year)


def rejected_heat01(spark: SparkSession, path: str) -> DataFrame:
    """(name, n, sample): malformed lines of each station file `CRNHE0101-<name>.csv` that `path` (a glob) names, and one of them.

    `read_heat01` skips these lines; a file may be a folder that Spark wrote.
    """
    schema = ", ".join(f"{c} STRING" for c in (*HEAT01_COLUMNS, "_bad"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    name = F.regexp_extract(F.col("_metadata.file_path"), r"CRNHE0101-([^/]+)\.csv", 1)
    parsed = spark.read.text(path).select(name.alias("name"), F.from_csv("value", schema, options)["_bad"].alias("_bad"))
    return parsed.where("_bad IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("_bad").alias("sample"))


# Accepted spellings of the radiation-station columns, preferred name first.
RADIATION_NAMES = {
    "station_id": ("station_id", "station"),
    "time_utc": ("time_utc", "timestamp_utc"),
    "LAT": ("LAT", "lat"),
    "LON": ("LON", "lon"),
    "TMRT_C_obs": ("TMRT_C_obs", "TMRT_C"),
    "UTCI_C_obs": ("UTCI_C_obs", "UTCI_C"),
}


def normalise_names(df: DataFrame, names: dict[str, Sequence[str]]) -> DataFrame:
    """Exactly the wanted columns, each from the first spelling present; none present is an error."""
    # Exact comparison: the spellings differ only in case, which Spark's resolver ignores.
    chosen = {want: next((s for s in options if s in df.columns), None) for want, options in names.items()}
    missing = [want for want, source in chosen.items() if source is None]
    if missing:
        raise KeyError(f"missing columns {missing}")
    return df.select(*[F.col(source).alias(want) for want, source in chosen.items()])


def load_radiation_stations(df: DataFrame) -> DataFrame:
    """station_id, time_utc, LAT, LON, TMRT_C_obs, UTCI_C_obs; rows without coordinates drop out."""
    out = normalise_names(df, RADIATION_NAMES)
    return out.select(
        F.col("station_id").cast("string"), F.col("time_utc").cast("timestamp_ntz"),
        finite(F.col("LAT").cast("double")).alias("LAT"), finite(F.col("LON").cast("double")).alias("LON"),
        finite(F.col("TMRT_C_obs").cast("double")).alias("TMRT_C_obs"),
        finite(F.col("UTCI_C_obs").cast("double")).alias("UTCI_C_obs"),
    ).dropna(subset=["LAT", "LON"])


def read_radiation_stations(spark: SparkSession, folder: str, year: int) -> DataFrame:
    return load_radiation_stations(spark.read.parquet(f"{folder}/SURFRAD_hourly_TMRT_UTCI_{year:04d}.parquet"))


def stations_without_coordinates(df: DataFrame, n: int = 10) -> DataFrame:
    """The stations losing most rows for want of coordinates."""
    named = normalise_names(df, {k: RADIATION_NAMES[k] for k in ("station_id", "LAT", "LON")})
    present = finite(F.col("LAT").cast("double")).isNotNull() & finite(F.col("LON").cast("double")).isNotNull()
    return worst_groups(named, ~present, "station_id", n)


def cached_year(spark: SparkSession, path: str, year: int, build, force: bool = False) -> DataFrame:
    """Observations of one year from the table at `path`, built and stored there when absent."""
    if not force:
        try:
            stored = spark.read.parquet(path).where(F.col("year") == year)
            if not stored.isEmpty():
                return stored.drop("year")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
    rows = build().withColumn("year", F.lit(year))
    (
        rows.repartitionByRange("station_id", "time_utc").sortWithinPartitions("station_id", "time_utc").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    )
    return spark.read.parquet(path).where(F.col("year") == year).drop("year")
