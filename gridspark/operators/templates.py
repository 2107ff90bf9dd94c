"""Diurnal templates of coarse cells and their use on daily fine values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridspark.functions.humidity import shifted_vapor_pressure
from gridspark.functions.missing import clip
from gridspark.operators.interpolate import in_order, spread_hours


def day_anomalies(df: DataFrame, keys: Sequence[str], value: str, day: str = "prism_day") -> DataFrame:
    """Rows with day_mean, anomaly, amin, amax and `frac`, the anomaly scaled to 0..1.

    Missing hours are skipped. `frac` is NULL for a flat day.
    """
    w = Window.partitionBy(*keys, day)
    anomaly = F.col("anomaly")
    out = df.withColumn("day_mean", F.avg(value).over(w)).withColumn("anomaly", F.col(value) - F.col("day_mean"))
    out = out.withColumns({"amin": F.min(anomaly).over(w), "amax": F.max(anomaly).over(w)})
    span = F.col("amax") - F.col("amin")
    return out.withColumn("frac", F.when(span > 0, (anomaly - F.col("amin")) / span))


def full_day_mean(df: DataFrame, keys: Sequence[str], value: str, day: str = "prism_day") -> DataFrame:
    """Day means of the days on which all 24 hours are present."""
    return df.groupBy(*keys, day).agg(F.avg(value).alias("day_mean"), F.count(value).alias("hours")).where(
        F.col("hours") == 24
    ).drop("hours")


def hourly_template(
    df: DataFrame, keys: Sequence[str], temperature: str, dewpoint: str, day: str = "prism_day", hour: str = "ph"
) -> DataFrame:
    """One row per coarse cell and day: `hours` (24 structs of t, td), `t_low`, `t_high`, `td_mean`.

    Needs the cell in both UTC days and a temperature range above zero; `td_mean` is NULL unless
    all 24 dewpoints are present. One shuffle; packing keeps the later join at one row per cell
    and day.
    """
    entry = F.struct(F.col(temperature).alias("t"), F.col(dewpoint).alias("td"))
    packed = df.groupBy(*keys, day).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(hour), entry))).alias("_by_hour"),
        F.min(temperature).alias("t_low"), F.max(temperature).alias("t_high"),
        F.avg(dewpoint).alias("_mean"), F.count(dewpoint).alias("_n"),
        F.max(F.col(hour) < 12).alias("_early"), F.max(F.col(hour) >= 12).alias("_late"),
    ).where("_early AND _late AND t_high > t_low")
    return packed.select(
        *keys, day, in_order("_by_hour").alias("hours"), "t_low", "t_high",
        F.when(F.col("_n") == 24, F.col("_mean")).alias("td_mean"))


def template_hour() -> tuple[Column, Column]:
    """(fraction of the temperature range, dewpoint) of a joined template whose `hours` are spread (see `spread_hours`)."""
    entry = F.col("hours")
    return (entry["t"] - F.col("t_low")) / (F.col("t_high") - F.col("t_low")), entry["td"]


def scaled_temperature(tmin: Column, tmax: Column, frac: Column) -> Column:
    """Daily range filled with the template's shape, limited to the range."""
    return clip(tmin + frac * (tmax - tmin), tmin, tmax)


def downscale(
    cells: DataFrame, template: DataFrame, cell_keys: Sequence[str], template_keys: Sequence[str],
    day: str = "prism_day", floor_hpa: float = 0.05,
) -> DataFrame:
    """Hourly `t2m` (C) and `ea` (hPa) per fine cell from daily tmin, tmax, tdmean.

    Cells without a valid range or without a valid template drop out; `ea` is NULL without a
    mean dewpoint or a full dewpoint curve. The join runs on one row per cell and day.
    """
    daily = cells.where("tmin IS NOT NULL AND tmax > tmin")
    joined = spread_hours(daily.join(template, [*template_keys, day]), ["hours"])
    frac, td = template_hour()
    hourly = joined.select(
        *cell_keys, day, "ph", "tdmean", "td_mean", td.alias("_td"),
        scaled_temperature(F.col("tmin"), F.col("tmax"), frac).alias("t2m"))
    ea = shifted_vapor_pressure(F.col("_td"), F.col("td_mean"), F.col("tdmean"), F.col("t2m"), floor_hpa)
    return hourly.select(*cell_keys, day, "ph", "t2m", ea.alias("ea"))
