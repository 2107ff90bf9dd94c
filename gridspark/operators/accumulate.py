"""Hourly flux from counters that restart every UTC day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SECONDS = 3600.0


def deaccumulate(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], utc_day: str = "d", hour: str = "hr",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Mean flux of each hour: next reading minus this one, over 3600 s.

    The counter restarts with the day, so hour 0 takes the reading of hour 1 as it is, and
    hour 23 needs hour 0 of the next day. A missing successor gives NULL. Columns in `carry` are
    kept as they are.

    The window is one key and one day: readings of hour 0 are copied into the day before as an
    hour 24, so no group grows with the length of the series.
    """
    days = F.when(
        F.col(hour) == 0, F.array(F.struct(F.col(utc_day).alias("day"), F.lit(0).alias("h")),
                                  F.struct(F.date_sub(utc_day, 1).alias("day"), F.lit(24).alias("h")))
    ).otherwise(F.array(F.struct(F.col(utc_day).alias("day"), F.col(hour).cast("int").alias("h"))))
    placed = df.select(*keys, *carry, *values, F.explode(days).alias("_at")).select(
        *keys, F.col("_at.day").alias(utc_day), F.col("_at.h").alias(hour), *carry, *values
    )
    w = Window.partitionBy(*keys, utc_day).orderBy(hour)
    follows = F.lead(hour).over(w) == F.col(hour) + 1
    flux = [
        F.when(
            follows,
            (F.lead(v).over(w) - F.when(F.col(hour) == 0, F.lit(0.0)).otherwise(F.col(v))) / SECONDS,
        ).alias(v)
        for v in values
    ]
    return placed.select(*keys, utc_day, hour, *carry, *flux).where(F.col(hour) < 24)


def longwave(
    df: DataFrame, keys: Sequence[str], net: str = "str", down: str = "strd",
    utc_day: str = "d", hour: str = "hr", drop_negative_down: bool = True, carry: Sequence[str] = (),
) -> DataFrame:
    """Columns lwdown, lwnet and lwup (down minus net) from the two accumulated counters."""
    flux = deaccumulate(df, keys, [net, down], utc_day, hour, carry)
    kept = F.when(F.col(down) >= 0, F.col(down)) if drop_negative_down else F.col(down)
    return flux.select(
        *keys, utc_day, hour, *carry,
        kept.alias("lwdown"), F.col(net).alias("lwnet"), (F.col(down) - F.col(net)).alias("lwup"),
    )
