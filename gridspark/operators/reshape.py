"""Wide hour columns to long rows and back, and half-hour to hour resampling."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.missing import clip, finite

HOUR_COLUMN = re.compile(r"_(?:ph|h)(\d{2})$")


def hour_columns(columns: Sequence[str], prefixes: Sequence[str], hours: int = 24) -> list[str]:
    """The hour columns of the first prefix that has exactly `hours` of them, in hour order."""
    for prefix in prefixes:
        found = {}
        for name in columns:
            match = HOUR_COLUMN.search(name)
            if match and name.startswith(f"{prefix}_"):
                found[name] = int(match.group(1))
        if len(found) == hours:
            return sorted(found, key=found.__getitem__)
    raise ValueError(f"no {hours} hour columns for prefixes {list(prefixes)}")


def wide_to_long(
    df: DataFrame, keys: Sequence[str], value_columns: Sequence[str], value: str, hour: str = "hr"
) -> DataFrame:
    """One row per key and hour; the position in `value_columns` is the hour. A narrow operation."""
    packed = F.array(*[F.col(c).cast("double") for c in value_columns])
    return df.select(*keys, F.posexplode(packed).alias(hour, value)).withColumn(value, finite(F.col(value)))


def long_to_wide(
    df: DataFrame, keys: Sequence[str], value: str, hour: str, prefix: str, hours: int = 24
) -> DataFrame:
    """24 columns `<prefix>00..23` per key, in one aggregation that combines before the shuffle."""
    columns = [
        F.max(F.when(F.col(hour) == h, F.col(value))).alias(f"{prefix}{h:02d}") for h in range(hours)
    ]
    return df.groupBy(*keys).agg(*columns)


def half_hour_to_hour(
    df: DataFrame, keys: Sequence[str], values: dict[str, str], slot: str = "slot", hour: str = "hr"
) -> DataFrame:
    """Mean of the two half-hour slots of each hour.

    `values` maps a column to its kind: `flux` (plain mean), `albedo` (thousandths, limited to
    0..1) or `zenith` (hundredths of a degree, averaged as cosine). An hour with a missing slot
    is NULL.
    """
    prepared = {name: _prepared(F.col(name), kind) for name, kind in values.items()}
    keyed = df.withColumns({hour: F.floor(F.col(slot) / 2).cast("int"), **prepared})
    means = [
        _finished(F.when(F.count(name) == 2, F.avg(name)), kind).alias(name)
        for name, kind in values.items()
    ]
    return keyed.groupBy(*keys, hour).agg(*means)


def _prepared(value: Column, kind: str) -> Column:
    if kind == "flux":
        return value
    if kind == "albedo":
        return clip(value / 1000.0, 0.0, 1.0)
    if kind == "zenith":
        return F.cos(F.radians(value / 100.0))
    raise ValueError(f"unknown kind {kind!r}")


def _finished(mean: Column, kind: str) -> Column:
    return F.degrees(F.acos(clip(mean, -1.0, 1.0))) if kind == "zenith" else mean
