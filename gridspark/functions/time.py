"""The 12Z-to-12Z day, time keys, seasons and window labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shifted_day(ts: Column) -> Column:
    """Label of the 24-hour window (D-1 12:00 .. D 11:59) that holds `ts`."""
    return F.to_date(ts + F.expr("INTERVAL 12 HOURS"))


def shifted_hour(ts: Column) -> Column:
    """Position 0..23 inside that window."""
    return ((F.hour(ts) + 12) % 24).cast("int")


def shifted_day_of(utc_day: Column, hour: Column) -> Column:
    """As `shifted_day`, for a date plus an hour of day."""
    return F.when(hour >= 12, F.date_add(utc_day, 1)).otherwise(utc_day)


def shifted_hour_of(hour: Column) -> Column:
    return ((hour + 12) % 24).cast("int")


def timestamp_of(prism_day: Column, ph: Column) -> Column:
    """UTC timestamp (no zone) of a window label and position."""
    start = prism_day.cast("timestamp_ntz") - F.expr("INTERVAL 12 HOURS")
    return start + F.make_dt_interval(hours=ph)


def day_timestamps(prism_day: Column) -> Column:
    """The 24 hourly timestamps of a window."""
    start = prism_day.cast("timestamp_ntz")
    return F.sequence(
        start - F.expr("INTERVAL 12 HOURS"),
        start + F.expr("INTERVAL 11 HOURS"),
        F.expr("INTERVAL 1 HOUR"),
    )


def time_columns(prism_day: Column, ph: Column, mode: str = "utc") -> dict[str, Column]:
    """year, month, day, time; real UTC hours in mode `utc`, the label and 0..23 in mode `prism`."""
    if mode == "prism":
        stamp, hour = prism_day, ph
    elif mode == "utc":
        stamp = F.when(ph < 12, F.date_sub(prism_day, 1)).otherwise(prism_day)
        hour = (ph + 12) % 24
    else:
        raise ValueError("time mode must be 'utc' or 'prism'")
    return {
        "year": F.year(stamp).cast("int"),
        "month": F.month(stamp).cast("int"),
        "day": F.dayofmonth(stamp).cast("int"),
        "time": hour.cast("int"),
    }


def pack_time(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """yyyymmddhh as one bigint."""
    big = lambda c: c.cast("bigint")
    return big(year) * 1_000_000 + big(month) * 10_000 + big(day) * 100 + big(hour)


def unpack_time(key: Column) -> dict[str, Column]:
    part = lambda div, mod: (F.floor(key / div) % mod).cast("int")
    return {
        "year": F.floor(key / 1_000_000).cast("int"),
        "month": part(10_000, 100),
        "day": part(100, 100),
        "time": (key % 100).cast("int"),
    }


def stamp_from_parts(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """Timestamp, NULL when the parts are not a valid time."""
    return F.call_function(
        "try_make_timestamp_ntz",
        year, month, day, hour, F.lit(0), F.lit(0).cast("decimal(16,6)"),
    )


def stamp_from_text(text: Column) -> Column:
    """Timestamp from yyyyMMddHH, NULL when malformed."""
    text = F.trim(text)
    part = lambda start, size: F.substring(text, start, size).cast("int")
    return F.when(
        text.rlike(r"^\d{10}$"),
        stamp_from_parts(part(1, 4), part(5, 2), part(7, 2), part(9, 2)),
    )


def day_from_doy(year: Column, doy: Column) -> Column:
    """Date of a day of year; a day the year does not have is an error."""
    candidate = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))
    valid = (doy >= 1) & (F.year(candidate) == year)
    return F.when(valid, candidate).otherwise(F.raise_error(F.lit("day of year outside the year")))


def in_day_range(ts: Column, start_day: Column, end_day: Column) -> Column:
    """Half-open [start - 12 h, end + 12 h), so a 12:00 observation belongs to the next window."""
    first = start_day.cast("timestamp_ntz") - F.expr("INTERVAL 12 HOURS")
    last = end_day.cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")
    return (ts >= first) & (ts < last)


def season(day: Column) -> Column:
    month = F.month(day)
    return (
        F.when(month.isin(12, 1, 2), F.lit("DJF"))
        .when(month.isin(3, 4, 5), F.lit("MAM"))
        .when(month.isin(6, 7, 8), F.lit("JJA"))
        .when(month.isin(9, 10, 11), F.lit("SON"))
    )


def window_label(start: Column, end: Column) -> Column:
    """`2010 Jul 15–21 (JJA)`, or with both months named when they differ."""
    same = F.concat(
        F.date_format(start, "yyyy MMM dd"), F.lit("–"), F.date_format(end, "dd"),
    )
    differ = F.concat(
        F.date_format(start, "yyyy MMM dd"), F.lit("–"), F.date_format(end, "MMM dd"),
    )
    body = F.when(F.month(start) == F.month(end), same).otherwise(differ)
    return F.concat(body, F.lit(" ("), season(start), F.lit(")"))


def window_tag(start: Column, end: Column) -> Column:
    first = F.date_format(start, "yyyy-MM-dd")
    return F.when(start == end, first).otherwise(
        F.concat(first, F.lit("_to_"), F.date_format(end, "yyyy-MM-dd"))
    )
